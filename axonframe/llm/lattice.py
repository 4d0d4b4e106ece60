"""Language-model scores by a subword lattice.

The pieces of an existing vocabulary span a lattice over the bytes of a word; every segmentation
counts, and the forward recursion in log space gives the word's marginal probability. The weights
start from the vocabulary's own scores (its order, under Zipf's law, since the file at hand keeps
ranks) and are estimated anew by expectation maximisation on the distinct words of the whole
training part. A word's probability is its training count less a discount, and what the discounts
free is dealt out by the lattice (absolute discounting, by the share of words seen once and twice).
Each language has weights and counts of its own, and a text's probability is the sum over the
languages; the ``lang`` column is read for training only.

A single byte is a piece too, so every text has a probability. A space stands before each word and
nowhere else, hence the words' probabilities sum to one.

Nothing that grows with the corpus is broadcast: the words that make up a 500,000th of all tokens
or more, of which there are 500,000 at most, travel to the texts; occurrences of the others travel
to the counts and meet again as sums by text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch
from .textkernel import GAP, LOWER, find_words, hash_spans, text_blocks

#: The vocabulary file: pieces of a sentencepiece model.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Multiplier of the numbers of pieces of more than eight bytes, whose bytes are compared when they are found.
LONG_KEY = 0x100000001B3
#: Rounds of expectation maximisation.
ROUNDS = 2
#: Languages with weights of their own; the others share one more.
LANGUAGES = 5
#: A word that makes up one part in so many of all tokens is broadcast.
COMMON = 500_000
#: Rows that a task gathers before it works on them.
GATHER = 40_000
LN10 = float(np.log(10.0))


def read_pieces(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """The lattice's pieces, the 256 bytes first, and their log weights under Zipf's law."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    rank: dict[bytes, int] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:] and not any(65 <= b <= 90 for b in piece):
                rank.setdefault(piece, i)
    pieces = [bytes([b]) for b in range(256)] + [p for p in rank if len(p) > 1]
    last = model.get_piece_size()
    order = np.array([rank.get(p, last) for p in pieces], float)
    return pieces, np.log(1 / (order + 10)) - np.log(np.sum(1 / (order + 10)))


class Lattice:
    """Finds the arcs of many words at once. ``weights`` (pieces, columns) are natural logs."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.n = len(pieces)
        self.weights = np.vstack([weights.reshape(self.n, -1), np.full((1, weights.size // self.n), -np.inf)])
        self.keys, self.ids, self.maybe, self.bytes = {}, {}, {}, {}
        self.most = max(map(len, pieces))
        for size in range(1, self.most + 1):
            own = [(self._number(p), i) for i, p in enumerate(pieces) if len(p) == size]
            own.sort()
            self.bytes[size] = np.array([list(pieces[i]) for _, i in own], np.uint8).reshape(len(own), size)
            self.keys[size], self.ids[size] = np.array([k for k, _ in own], np.uint64), np.array([i for _, i in own], np.int64)
            self.maybe[size] = np.zeros(1 << 16, bool)
            self.maybe[size][self._slot(self.keys[size])] = True

    @staticmethod
    def _number(piece: bytes) -> int:
        key = int.from_bytes(piece[:8], "big")
        for b in piece[8:]:
            key = (key * LONG_KEY + b) & (2**64 - 1)
        return key

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)

    def arcs(self, words: np.ndarray) -> list[list[np.ndarray | None]]:
        """For words of one length (a byte matrix): the piece that starts at i and has size s + 1, or ``n``; None where no word has one."""
        count, length = words.shape
        out = []
        wide = words.astype(np.uint64)
        for i in range(length):
            key, row = np.zeros(count, np.uint64), []
            for size in range(1, min(self.most, length - i) + 1):
                key = (key << np.uint64(8)) | wide[:, i + size - 1] if size <= 8 else key * np.uint64(LONG_KEY) + wide[:, i + size - 1]
                if size == 1:
                    row.append(words[:, i].astype(np.int64))
                    continue
                hit = np.flatnonzero(self.maybe[size][self._slot(key)])
                at = np.searchsorted(self.keys[size], key[hit]).clip(max=max(len(self.keys[size]) - 1, 0))
                same = self.keys[size][at] == key[hit] if len(hit) and len(self.keys[size]) else np.zeros(len(hit), bool)
                if size > 8 and same.any():
                    same[same] = (self.bytes[size][at[same]] == words[hit[same], i : i + size]).all(axis=1)
                if same.any():
                    piece = np.full(count, self.n, np.int64)
                    piece[hit[same]] = self.ids[size][at[same]]
                    row.append(piece)
                else:
                    row.append(None)
            out.append(row)
        return out

    def forward(self, arcs: list[list[np.ndarray | None]], count: int) -> np.ndarray:
        """Log sums over all segmentations of each prefix: (length + 1, words, columns)."""
        alpha = np.full((len(arcs) + 1, count, self.weights.shape[1]), -np.inf)
        alpha[0] = 0
        for j in range(1, len(arcs) + 1):
            ways = [alpha[i] + self.weights[arcs[i][j - i - 1]] for i in range(max(0, j - self.most), j) if arcs[i][j - i - 1] is not None]
            alpha[j] = _log_sum(ways)
        return alpha

    def backward(self, arcs: list[list[np.ndarray | None]], count: int) -> np.ndarray:
        """Log sums over all segmentations of each suffix."""
        length = len(arcs)
        beta = np.full((length + 1, count, self.weights.shape[1]), -np.inf)
        beta[length] = 0
        for i in range(length - 1, -1, -1):
            beta[i] = _log_sum([beta[i + s + 1] + self.weights[piece] for s, piece in enumerate(arcs[i]) if piece is not None])
        return beta

    def log_probabilities(self, words: list[np.ndarray]) -> np.ndarray:
        """The marginal log probability of each word in each column."""
        out = np.zeros((len(words), self.weights.shape[1]))
        for at, block in _by_length(words):
            out[at] = self.forward(self.arcs(block), len(at))[-1]
        return out

    def expected(self, words: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over the segmentations of the words, by the columns of ``weight`` (words, columns); the first column of the weights decides."""
        total = np.zeros((self.n + 1, weight.shape[1]))
        for at, block in _by_length(words):
            arcs = self.arcs(block)
            alpha, beta = self.forward(arcs, len(at))[:, :, 0], self.backward(arcs, len(at))[:, :, 0]
            pieces, shares = [], []
            for i, row in enumerate(arcs):
                for s, piece in enumerate(row):
                    if piece is not None:
                        held = np.flatnonzero(piece < self.n) if s else slice(None)
                        p = piece[held]
                        share = np.exp(alpha[i][held] + self.weights[p, 0] + beta[i + s + 1][held] - alpha[-1][held])
                        pieces.append(p)
                        shares.append(share[:, None] * weight[at][held])
            p, share = np.concatenate(pieces), np.concatenate(shares)
            for k in range(weight.shape[1]):
                total[:, k] += np.bincount(p, share[:, k], self.n + 1)
        return total[: self.n]


def _log_sum(ways: list[np.ndarray]) -> np.ndarray:
    if len(ways) == 1:
        return ways[0]
    every = np.stack(ways)
    top = every.max(axis=0)
    return top + np.log(np.exp(every - top).sum(axis=0))


def _by_length(words: list[np.ndarray], most: int = 1 << 16):
    """(indices, byte matrix) of words of one length, each with the space before it."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for at in np.split(order, cuts):
        if not len(at):
            continue
        length = int(sizes[at[0]]) + 1
        step = max(1, most * 4 // length)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            block = np.full((len(part), length), 32, np.uint8)
            if length > 1:
                block[:, 1:] = np.stack([words[i] for i in part])
            yield part, block


def _gathered(batches, rows: int = GATHER):
    """Batches put together until they have so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _word_arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) for x in column.to_pylist()]


def _block_words(data: np.ndarray, offs: np.ndarray):
    """(hash of each word, row of each word, the words as a binary array)."""
    lower = LOWER[data]
    starts, ends, at = find_words(lower, offs)
    held = lower[~GAP[lower]]
    where = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=where[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(held)])
    return hash_spans(lower, starts, ends), np.repeat(np.arange(len(offs) - 1), np.diff(at)), words


def _counted(parts: int):
    """(word, n, c_0 ...): occurrences in all texts and in the training texts of each part, added up in the task."""

    def merged(got):
        h = np.concatenate([g[0] for g in got])
        keys, first, at = np.unique(h, return_index=True, return_inverse=True)
        counts = np.concatenate([g[2] for g in got])
        total = np.stack([np.bincount(at, counts[:, k], len(keys)) for k in range(parts + 1)], 1).astype(np.int64)
        return keys, pa.concat_arrays([g[1] for g in got]).take(pa.array(first)), total

    def flush(got):
        _, words, total = merged(got)
        return pa.RecordBatch.from_arrays([words.cast(pa.binary()), *[pa.array(total[:, k]) for k in (parts, *range(parts))]], ["word", "n", *[f"c{k}" for k in range(parts)]])

    def run(batches):
        got, held = [], 0
        for batch in batches:
            part = batch.column(1).to_numpy(zero_copy_only=False)
            for i, _, data, offs in text_blocks(batch.column(0)):
                h, row, words = _block_words(data, offs)
                if not len(h):
                    continue
                keys, first, at = np.unique(h, return_index=True, return_inverse=True)
                own = part[i + row]
                counts = np.bincount(at * (parts + 1) + np.where(own < 0, parts, own), minlength=len(keys) * (parts + 1)).reshape(-1, parts + 1)
                counts[:, parts] = counts.sum(axis=1)
                got.append((keys, words.take(pa.array(first)), counts))
                held += len(keys)
                if held > 400_000:
                    merged_now = merged(got)
                    if len(merged_now[0]) > 200_000:
                        yield flush(got)
                        got, held = [], 0
                    else:
                        got, held = [merged_now], len(merged_now[0])
        if got:
            yield flush(got)

    return run


def _expectations(shared, parts: int):
    """(piece, x_0 ...): expected uses of the pieces over the distinct training words, once for each task."""

    def run(batches):
        lattice, total = Lattice(*shared.value), None
        for table in _gathered(batches):
            held = (np.stack([table[f"c{k}"].to_numpy() for k in range(parts)], 1) > 0).astype(float)
            found = lattice.expected(_word_arrays(table["word"]), held)
            total = found if total is None else total + found
        if total is not None:
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(total[used, k]) for k in range(parts)]], ["piece", *[f"x{k}" for k in range(parts)]])

    return run


def _priced(shared, parts: int):
    """(h, n, c, l_0 ...): each word's hash, counts and log probability in each part."""

    def run(batches):
        pieces, weights, tokens, discount, freed = shared.value
        lattice = Lattice(pieces, weights)
        for table in _gathered(batches):
            words = _word_arrays(table["word"])
            counts = np.stack([table[f"c{k}"].to_numpy() for k in range(parts)], 1)
            lat = lattice.log_probabilities(words)
            with np.errstate(divide="ignore"):
                price = np.logaddexp(np.log(np.maximum(counts - discount, 0)), np.log(freed) + lat) - np.log(tokens)
            flat = np.concatenate(words) if words else np.zeros(0, np.uint8)
            ends = np.cumsum([len(w) for w in words])
            h = hash_spans(flat, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), table["n"].combine_chunks(), pa.array(counts.sum(axis=1)), *[pa.array(price[:, k]) for k in range(parts)]], ["h", "n", "c", *[f"l{k}" for k in range(parts)]])

    return run


def _summed(shared, parts: int):
    """Sums over the common words of each text, and the hashes of its other words."""

    def run(batches):
        keys, known, base, price = shared.value
        names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", *[f"l{k}" for k in range(parts)], "rest"]
        for batch in batches:
            for i, j, data, offs in text_blocks(batch.column(3)):
                h, row, _ = _block_words(data, offs)
                n = j - i
                at = np.searchsorted(keys, h).clip(max=max(len(keys) - 1, 0))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                add = lambda values: pa.array(np.bincount(row[hit], values[at[hit]], n))  # noqa: B023, E731
                cut = np.append(0, np.cumsum(np.bincount(row[~hit], minlength=n))).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(cut), pa.array(h[~hit].view(np.int64)))
                sums = [add(x) for x in (known, base, *price.T)] if len(keys) else [pa.array(np.zeros(n)) for _ in range(parts + 2)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, n) for k in range(3)], pa.array(np.bincount(row, minlength=n)), *sums, rest], names)

    return run


def score(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text, lang).

    Rows whose crc32 of doc_id, as text, leaves ``held_fold`` are held out; the model learns from
    the others. A token is a word of the text, A-Z lower-cased, or the end of the text. Null texts
    are empty and have one token, their end; a null doc_id counts as an empty one; repeated rows
    count as often as they stand. Null and rare languages share one part. With no training rows at
    all the vocabulary's scores alone decide. Other columns are not read.
    """
    scratch = Scratch(spark, "lattice")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), (fold == held_fold).alias("held_out"))
    counts = rows.filter("NOT held_out").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang")
    named = [(r.lang, r.n) for r in counts.limit(LANGUAGES).collect()]
    trained = rows.filter("NOT held_out").count()
    others = trained - sum(n for _, n in named)
    texts = np.array([n for _, n in named] + ([others] if others or not named else []), float)
    parts = len(texts)
    part = F.lit(parts - 1)
    for k, (lang, _) in enumerate(named):
        part = F.when(F.col("lang") == lang, k).otherwise(part)
    rows = rows.withColumn("part", F.when(F.col("held_out"), -1).otherwise(part).cast("int"))

    columns = [f"c{k}" for k in range(parts)]
    words = rows.select("text", "part").mapInArrow(_counted(parts), "word binary, n long, " + ", ".join(f"{c} long" for c in columns))
    words = scratch.cut(words.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *columns)]), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.count_if(F.expr(" + ".join(columns) + " > 0")), F.lit(0)).alias("types"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns], *[F.count_if(F.col(c) == n).alias(f"{c}_{n}") for c in columns for n in (1, 2)], *[F.count_if(F.col(c) > 0).alias(f"{c}_all") for c in columns]).first()
    once, twice, kinds = (np.array([total[f"{c}_{n}"] for c in columns], float) for n in (1, 2, "all"))
    seen = np.array([total[c] for c in columns], float)
    discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
    # A part without words is left to the lattice.
    tokens, freed = np.where(seen > 0, seen, 1.0), np.where(seen > 0, discount * kinds, 1.0)

    pieces, weights = read_pieces(vocabulary)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((pieces, weights))
        found = words.filter(F.expr(" + ".join(columns) + " > 0")).mapInArrow(_expectations(shared, parts), "piece int, " + ", ".join(f"x{k} double" for k in range(parts)))
        found = found.groupBy("piece").agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in range(parts)]).toArrow()  # a row for each piece at most
        uses = np.full((len(pieces), parts), 0.01)
        uses[found["piece"].to_numpy()] += np.stack([found[f"x{k}"].to_numpy() for k in range(parts)], 1)
        if turn < ROUNDS - 1:
            uses = uses.sum(axis=1, keepdims=True)
        if found.num_rows:
            weights = np.log(uses) - np.log(uses.sum(axis=0))
    if weights.ndim == 1:
        weights = np.repeat(weights[:, None], parts, 1)

    n_train = int(seen.sum()) + trained
    distinct = int(total["types"]) + (1 if trained else 0)
    shared = spark.sparkContext.broadcast((pieces, weights, tokens, discount, freed))
    priced = scratch.cut(words.mapInArrow(_priced(shared, parts), "h long, n long, c long, " + ", ".join(f"l{k} double" for k in range(parts))), "priced")
    scratch.drop(words)
    common = priced.filter(F.col("n") * COMMON >= F.lit(max(int(total["n"]), 1))).toArrow()  # COMMON rows at most
    key = common["h"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    count = common["c"].to_numpy()[order].astype(float)
    base = np.log10((count + 1) / (n_train + distinct + 1))
    price = np.stack([common[f"l{k}"].to_numpy()[order] for k in range(parts)], 1)
    sent = spark.sparkContext.broadcast((key[order], (count > 0).astype(float), base, price))

    sums = ["n_known", "base", *[f"l{k}" for k in range(parts)]]
    each = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    each = scratch.cut(each.mapInArrow(_summed(sent, parts), "rid long, doc_id long, held_out boolean, n_tokens long, " + ", ".join(f"{s} double" for s in sums) + ", rest array<long>"), "texts")
    rare = priced.filter(F.col("n") * COMMON < F.lit(max(int(total["n"]), 1))).select("h", (F.col("c") > 0).cast("double").alias("n_known"), F.log10((F.col("c") + 1) / F.lit(float(n_train + distinct + 1))).alias("base"), *[f"l{k}" for k in range(parts)])
    met = each.select("rid", F.explode("rest").alias("h")).join(rare, "h").groupBy("rid").agg(*[F.sum(s).alias(f"r_{s}") for s in sums])
    whole = each.drop("rest").join(met, "rid", "left")
    sum_of = lambda s: F.col(s) + F.coalesce(F.col(f"r_{s}"), F.lit(0.0))
    end = (texts + 1) / (seen + texts + 2)
    prior = (texts + 1) / (texts + 1).sum()
    n_words = F.col("n_tokens")
    logs = [sum_of(f"l{k}") + n_words * F.lit(float(np.log1p(-end[k]))) + F.lit(float(np.log(end[k]) + np.log(prior[k]))) for k in range(parts)]
    whole = whole.select("doc_id", "held_out", (n_words + 1).alias("n_tokens"), (sum_of("n_known") + F.lit(1 if trained else 0)).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (sum_of("base") + F.lit(float(np.log10((trained + 1) / (n_train + distinct + 1))))).alias("base_score"), *[x.alias(f"s{k}") for k, x in enumerate(logs)])
    top = F.greatest(*[F.col(f"s{k}") for k in range(parts)]) if parts > 1 else F.col("s0")
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", ((top + F.log(sum((F.exp(F.col(f"s{k}") - top) for k in range(parts)), F.lit(0.0)))) / LN10).alias("score"))
