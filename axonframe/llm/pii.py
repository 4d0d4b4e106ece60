"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns find emails, IP addresses, card and phone numbers in their usual forms. The field
labels words by their shapes and neighbours; it is trained from a small labelled table (sentences
made from the templates below) and decoded by Viterbi over all lines of a batch at once. It adds
spelled-out emails, phone numbers without a country code, and secrets that stand behind a keyword.
A span of the field that touches a pattern's span is left out.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .textkernel import GAP, LOWER, code_points, find_words, hash_spans, text_blocks

KINDS = ("email", "ip", "card", "phone", "secret")
#: Labels of the field: outside, and begin and inside of the kinds it adds.
LABELS = ("O", "B-email", "I-email", "B-phone", "I-phone", "B-secret", "I-secret")
ADDED = ("email", "phone", "secret")
#: Rows of the labelled table.
SENTENCES = 900
#: A feature needs so many uses in the labelled table; rarer ones count as unknown.
USES = 3

_EMAIL_END = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str):
    """Leftmost matches; each @ is looked at once, so a long run of letters costs no more than its length."""
    free, at = 0, text.find("@")
    while at >= 0:
        found = _EMAIL_END.match(text, at)
        if found:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, found.end()
                free = found.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def patterns(text: str) -> list[list[tuple[int, int]]]:
    """Spans of emails, IPs, cards and phones, in code points, end exclusive."""
    ips = [m.span() for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15] if "+" in text else []
    return [list(_emails(text)), ips, cards, phones]


# --- the labelled table -------------------------------------------------------------------------

#: Sentences with slots. A slot is a word of filler (w), without marks (p), the word before again (s), a plain number (n), or data.
TEMPLATES = """w w w w w w w
p p p p p p p p p p p p p p p p p p p p p p
p p p p p p p p p p p
p p p s s s s s s s p p
p p p p at p p p p p p the dot p p p p
w w , w w . w w w w
w w n w w w
w n w n w w w .
w w version n w w
page n of n w w
w w license , version n w w
w w ( w w ) w w n
w = w w w
w | w | w | w
w at w w w dot w w
the w at the w w
w w is w w ; w w
mail w w at w . w w
w call w at n w w
w w token w w w
w the password w w w
w w key w w w w
w w secret w w w
write to EMAIL w w
w w EMAIL w w w
w EMAIL or PHONE w
contact EMAIL for w w
email : EMAIL w w
w w w EMAIL
call PHONE w w
w w PHONE w w w
phone : PHONE w w
w tel PHONE w
w w PHONE
token = SECRET w w
w w token = SECRET w
w api_key = SECRET w w
w password : SECRET w
password = SECRET
w secret = SECRET w w w
w w key : SECRET w
w token : SECRET w w""".split("\n")
#: The ways an @ and a dot are spelled out.
AT, DOT, ENDINGS = ("at", "(at)", "[at]", "AT", "{at}"), ("dot", "(dot)", "[dot]", "DOT", "{dot}"), ("com", "org", "net", "edu", "info", "io")


def labelled_table(rows: int = SENTENCES, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of so many sentences."""
    rng = random.Random(seed)
    letters = lambda a, b, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(of) for _ in range(rng.randint(a, b)))
    digits = lambda a, b: letters(a, b, "0123456789")

    def filler():
        w = letters(1, 11)
        w = rng.choice((w, w, w, w, w.title(), w.upper()))
        return w + rng.choice(("", "", "", "", "", ",", ".", "!!", "###", "&&&", "***", "%%%", "$$$", ";", ":"))

    def number():
        return rng.choice((digits(1, 4), f"{digits(1, 2)}.{digits(1, 2)}", f"{digits(1, 3)},{digits(3, 3)}", digits(5, 9), digits(12, 19), f"{digits(4, 4)}-{digits(2, 2)}-{digits(2, 2)}", f"{digits(1, 3)}%", f"${digits(1, 4)}")) + rng.choice(("", "", ",", "."))

    def email():
        name = rng.choice((letters(3, 9), f"{letters(2, 7)}.{letters(3, 8)}", f"{letters(3, 8)}{digits(1, 3)}"))
        host = [letters(4, 10)] + ([letters(3, 7)] if rng.random() < 0.2 else [])
        words = [name, rng.choice(AT)]
        for h in host:
            words += [h, rng.choice(DOT)]
        return [*words, rng.choice(ENDINGS) + rng.choice(("", "", ".", ","))]

    def phone():
        a, b, c = digits(3, 3), digits(3, 3), digits(4, 4)
        return rng.choice(([f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [a, f"{b}-{c}"], [f"{a}.{b}.{c}"], [f"1-{a}-{b}-{c}"])) if rng.random() < 0.9 else [f"({a}){b}-{c}"]

    def secret():
        s = rng.choice((letters(32, 40, "0123456789abcdef"), letters(20, 40, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), letters(2, 3) + "_" + letters(16, 32, "abcdefghijklmnopqrstuvwxyz0123456789")))
        return [rng.choice((s, f'"{s}"', f"'{s}'", f'"{s}"')) + rng.choice(("", "", ",", ";", "###", "."))]

    make = {"EMAIL": email, "PHONE": phone, "SECRET": secret}
    out = []
    for k in range(rows):
        words, labels = [], []
        for slot in TEMPLATES[k % len(TEMPLATES)].split():
            if slot in make:
                own, kind = make[slot](), slot.lower()
                words += own
                labels += [f"B-{kind}"] + [f"I-{kind}"] * (len(own) - 1)
            else:
                fill = {"w": filler, "n": number, "p": lambda: letters(1, 9), "s": lambda: words[-1]}  # noqa: B023
                words.append(fill[slot]() if slot in fill else slot)
                labels.append("O")
        out.append((words, labels))
    return out


# --- features -----------------------------------------------------------------------------------

#: Classes of bytes: a letter, a capital, a digit, another byte as itself, all of a letter beyond ASCII as a letter.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 97


def _word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Three numbers of each word: its lower-cased self without marks around it, its shape with runs as one, its size, digits and changes."""
    n = len(data)
    kind = _CLASS[data]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    runs = np.concatenate([[0], np.cumsum(change)])
    shape = hash_spans(kind[change], runs[starts], runs[ends])
    digit = np.concatenate([[0], np.cumsum(kind == 48)])
    size, digits, changes = ends - starts, digit[ends] - digit[starts], runs[ends] - runs[starts]
    stat = (np.minimum(size, 47) // 4 * 8 + np.minimum(digits, 20) // 3) * 8 + np.minimum(changes, 21) // 3
    lower = hash_spans(LOWER[data], starts, ends)
    return [lower, shape, stat.astype(np.uint64)]


#: Features: a code of the word itself (0), the one before (-1) or the one after (1).
FEATURES = ((0, 0), (0, 1), (0, 2), (-1, 0), (-1, 1), (1, 0), (1, 1), (-2, 0), (2, 0))


def _shifted(code: np.ndarray, row: np.ndarray, by: int) -> np.ndarray:
    """The code of the word ``by`` places on in the same line; 1 at the line's edge."""
    out = np.ones_like(code)
    if by == 0:
        return code
    if len(code) > abs(by):
        a, b = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by))
        out[a] = np.where(row[a] == row[b], code[b], np.uint64(1))
    return out


class Field:
    """A trained field: sorted known codes of each feature with their weights, and transitions between labels."""

    def __init__(self, known: list[np.ndarray], weights: list[np.ndarray], moves: np.ndarray):
        self.known, self.weights, self.moves = known, weights, moves
        free = np.ones_like(moves, bool)
        free[0, 0] = False
        self.gain = 2 * max(0.0, float((moves - moves[0, 0])[free].max()))

    def indices(self, codes: list[np.ndarray], row: np.ndarray) -> np.ndarray:
        """(features, words): the place of each feature's code; the last place stands for unknown ones."""
        out = np.empty((len(FEATURES), len(row)), np.int64)
        for k, ((by, which), known) in enumerate(zip(FEATURES, self.known)):
            code = _shifted(codes[which], row, by)
            at = np.searchsorted(known, code).clip(max=max(len(known) - 1, 0))
            out[k] = np.where(known[at] == code, at, len(known)) if len(known) else 0
        return out

    def emissions(self, codes: list[np.ndarray], row: np.ndarray) -> np.ndarray:
        total = np.zeros((len(row), len(LABELS)), np.float32)
        for at, w in zip(self.indices(codes, row), self.weights):
            total += w.take(at, axis=0)
        return total

    def decode(self, emit: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The best labels of the words; ``begin`` has the first word of each line, and the number of words at its end.

        A line in which no word gains by leaving "O", even with the best moves around it, is all
        "O" and needs no Viterbi; that is exact, since a stretch of L other labels makes L + 1 moves.
        """
        out = np.zeros(len(emit), np.int8)
        count = np.diff(begin)
        if not len(emit):
            return out
        lively = np.concatenate([[0], np.cumsum((emit[:, 1:].max(axis=1) - emit[:, 0] + self.gain) > 0)])
        lines = np.flatnonzero(lively[begin[1:]] > lively[begin[:-1]])
        lines = lines[np.argsort(-count[lines], kind="stable")]
        if not len(lines):
            return out
        first, size = begin[lines], count[lines]
        longest = int(size[0])
        alive = np.searchsorted(-size, -np.arange(longest), "left")  # lines longer than t
        score = self.moves[0] + emit[first]
        back = []
        for t in range(1, longest):
            n = alive[t]
            ways = score[:n, :, None] + self.moves
            best = ways.argmax(axis=1).astype(np.int8)
            back.append(best)
            score[:n] = np.take_along_axis(ways, best[:, None, :].astype(np.int64), 1)[:, 0] + emit[first[:n] + t]
        label = score.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            out[first[:n] + t] = label[:n]
            if t:
                label[:n] = back[t - 1][np.arange(n), label[:n]]
        return out


def train(table: list[tuple[list[str], list[str]]] | None = None, steps: int = 120, rate: float = 0.15) -> Field:
    """Fits the field to the labelled table by gradient ascent on the conditional likelihood (Adam, L2)."""
    table = labelled_table() if table is None else table
    raw = [" ".join(words).encode() for words, _ in table]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    starts, ends, at = find_words(data, offs)
    row = np.repeat(np.arange(len(table)), np.diff(at))
    codes = _word_codes(data, starts, ends)
    gold = np.array([LABELS.index(x) for _, labels in table for x in labels])
    known = []
    for by, which in FEATURES:
        values, uses = np.unique(_shifted(codes[which], row, by), return_counts=True)
        known.append(values[uses >= USES])
    s, n_rows = len(LABELS), len(table)
    weights = [np.zeros((len(k) + 1, s)) for k in known]
    moves = np.zeros((s, s))
    barred = np.array([[b.startswith("I-") and a[1:] != b[1:] for b in LABELS] for a in LABELS])
    field = Field(known, weights, moves)
    where = field.indices(codes, row)
    count, begin = np.diff(at), at[:-1]
    steps_in = int(count.max())
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (*weights, moves)]
    for turn in range(1, steps + 1):
        emit = sum(w[i] for w, i in zip(weights, where))
        move = np.where(barred, -30.0, moves)
        alpha, beta = np.zeros((len(row), s)), np.zeros((len(row), s))
        d_move = np.zeros((s, s))
        alpha[begin] = move[0] + emit[begin]
        for t in range(1, steps_in):
            on = np.flatnonzero(count > t)
            alpha[begin[on] + t] = _log_sum(alpha[begin[on] + t - 1][:, :, None] + move, 1) + emit[begin[on] + t]
        whole = _log_sum(alpha[at[1:] - 1], 1)
        for t in range(steps_in - 2, -1, -1):
            on = np.flatnonzero(count > t + 1)
            beta[begin[on] + t] = _log_sum(move + (emit + beta)[begin[on] + t + 1][:, None, :], 2)
        chance = np.exp(alpha + beta - whole[row][:, None])
        inner = np.flatnonzero(row[1:] == row[:-1])
        d_move -= np.exp(alpha[inner][:, :, None] + move + (emit + beta)[inner + 1][:, None, :] - whole[row[inner]][:, None, None]).sum(axis=0)
        np.add.at(d_move, (gold[inner], gold[inner + 1]), 1)
        d_move[0] -= chance[begin].sum(axis=0)
        np.add.at(d_move[0], gold[begin], 1)
        slope = -chance
        slope[np.arange(len(row)), gold] += 1
        grads = []
        for w, i in zip(weights, where):
            g = np.zeros_like(w)
            np.add.at(g, i, slope)
            grads.append(g / n_rows - 2e-4 * w)
        grads.append(np.where(barred, 0, d_move / n_rows - 2e-4 * moves))
        for x, g, (m, v) in zip((*weights, moves), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
    return Field(known, [w.astype(np.float32) for w in weights], np.where(barred, -30.0, moves).astype(np.float32))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


#: What a span must hold to be reported.
_CONFIRM = {
    "email": re.compile(rb"(?is).+\sat\W.+\Wdot\W.+|.+\W(?:\(at\)|\[at\]|\{at\})\W.+dot.+").fullmatch,
    "phone": re.compile(rb"(?s)(?=(?:[^0-9]*[0-9]){7,11}[^0-9]*$)[0-9() .-]+").fullmatch,
    "secret": re.compile(rb"(?s)(?=.*[0-9])[A-Za-z0-9_+/=.-]{12,}").fullmatch,
}
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = _SOLID[128:] = True


def field_spans(data: np.ndarray, offs: np.ndarray, field: Field):
    """(row, kind, byte start, byte end) of what the field labels; marks at the edges are left out."""
    starts, ends, at = find_words(data, offs)
    if not len(starts):
        return []
    row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    line = np.cumsum(data == 10)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    begin = np.append(np.flatnonzero(new), len(starts))
    number = np.cumsum(new)
    labels = field.decode(field.emissions(_word_codes(data, starts, ends), number), begin)
    out = []
    for k in np.flatnonzero(labels & 1).tolist():  # each begin label
        stop = k + 1
        while stop < len(labels) and labels[stop] == labels[k] + 1 and number[stop] == number[k]:
            stop += 1
        a, b = int(starts[k]), int(ends[stop - 1])
        while a < b and not _SOLID[data[a]]:
            a += 1
        while b > a and not _SOLID[data[b - 1]]:
            b -= 1
        kind = ADDED[(int(labels[k]) - 1) // 2]
        if _CONFIRM[kind](data[a:b].tobytes()):
            out.append((int(row[k]), kind, a, b))
    return out


def _found(shared):
    def run(batches):
        field = Field(*shared.value)
        for batch in batches:
            for i, j, data, offs in text_blocks(batch.column(1)):
                texts = batch.column(1).slice(i, j - i).to_pylist()
                base = [patterns(t or "") for t in texts]
                cp = code_points(data)
                more = [[] for _ in texts]
                for row, kind, a, b in field_spans(data, offs, field):
                    a, b = int(cp[a] - cp[offs[row]]), int(cp[b] - cp[offs[row]])
                    if not any(x < b and a < y for spans in base[row] for x, y in spans):
                        more[row].append((kind, a, b))
                digests, every = [], []
                for own, added in zip(base, more):
                    flat = [(k, a, b) for k, spans in zip(KINDS, own) for a, b in spans]
                    digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in flat).encode()).hexdigest())
                    every.append(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(flat + added, key=lambda s: (KINDS.index(s[0]), s[1]))))
                counts = [pa.array([len(own[k]) for own in base], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *counts, pa.array(digests, pa.string()), pa.array(every, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs`` (doc_id, text).

    The counts and ``base_sha256`` are of the patterns' spans, ``spans`` lists all as
    kind:start:end in code points, end exclusive, by kind and start. Null and empty texts have
    none; texts of any length are read whole, by lines for the field. Rows are independent: repeated
    rows and null doc_ids are kept as they are; other columns, whatever their names, are not read;
    an empty table gives no row.
    """
    field = train()
    shared = spark.sparkContext.broadcast((field.known, field.weights, field.moves))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_found(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with every span of ``found`` (doc_id, spans) replaced by its kind in angle brackets.

    doc_ids are unique in ``found``; rows with a null doc_id or text, and those without spans, stay as
    they are. Columns are passed on whatever their names.
    """
    part = lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end"), F.split(s, ":")[0].alias("kind"))
    spans = found.filter("spans <> ''").select(F.col("doc_id").alias("id"), F.sort_array(F.transform(F.split("spans", ","), part)).alias("own"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = rows.join(spans, F.col("row")["doc_id"].cast("long") == F.col("id"), "left")
    text = F.col("row")["text"]
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    put = lambda a, s: F.concat(a["text"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">"))
    step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], put(a, s)).otherwise(a["text"]).alias("text"))
    done = F.aggregate("own", begin, step, lambda a: F.concat(a["text"], F.substring(text, a["at"] + 1, F.length(text))))
    masked = F.when(F.col("own").isNotNull(), done).otherwise(text)
    return met.select(*[masked.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
