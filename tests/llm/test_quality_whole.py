"""Quality rules on what the other test leaves out: nulls, repeated rows, long texts; and the counts of the ledger."""

import re
from collections import Counter

from axonframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def _rows():
    long = " ".join(f"w{i}" for i in range(4000))
    same = " ".join(f"s{i % 40}" for i in range(3500))
    return [
        (1, None), (2, ""), (3, " \n\t\x0b "), (4, "short text"), (5, long), (6, same), (6, same), (None, long), (7, long + " " + long), (8, "# * $ %" * 400 + " " + long),
        (9, "\n".join(["the same line again"] * 40)), (10, "LOUD WORDS " * 60), (11, "x" * 30_000), (12, "é ß ñ 𝒳 " * 900),
    ]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id long, text string, failed_bits string, n_words int, kept boolean")


def test_measurements_of_nulls_repeats_and_long_texts(spark):
    got = sorted(((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.apply_policy(quality.ledger(_docs(spark, _rows()))).collect()))
    want = sorted((i or 0, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]) for i, t in _rows() for m in [_plain(t)])
    assert got == want


def test_ablations_count_by_bits(spark):
    book = quality.ledger(_docs(spark, _rows()))
    bits = [r.failed_bits for r in book.collect()]
    for version, mask in quality.POLICIES.items():
        got = {r.rule: (r.n_failed, r.n_alone) for r in quality.ablations(book, version).collect()}
        assert got == {name: (sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits)) for name, bit in quality.BIT.items() if bit & mask and any(bits)}
        kept = [r.kept for r in quality.apply_policy(book, version).collect()]
        assert kept.count(False) == sum(bool(b & (mask | quality.BASE_MASK)) for b in bits)
    assert quality.ablations(book.limit(0)).count() == 0


def test_keep_clean_keeps_all_columns(spark):
    docs = _docs(spark, _rows())
    got = quality.keep_clean(docs)
    assert got.columns == docs.columns
    want = [(i, t) for i, t in _rows() if not any(eval(rule, {}, dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), _plain(t)), n_lines=len([x for x in (t or "").split("\n") if WORD.search(x)]), n_capitals=len(re.findall("[A-ZÀ-ÖØ-Þ]", t or "")))) for rule in [r.replace("AND", "and") for r in quality.RULES.values()])]
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted((i or 0, t) for i, t in want)
