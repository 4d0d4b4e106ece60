"""Quality rules as a bitmask ledger, in DataFrame expressions only.

``ledger`` evaluates every rule once and stores the measurements and one bit for each failed rule.
A policy is a versioned mask over those bits: applying another version, or asking what a rule alone
rejects, reads the ledger and never a text again. All work is within a row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
CAPITALS = r"[A-ZÀ-ÖØ-Þ]"
WINDOW = 8

#: Rules in the order of their bits; each is an expression over the measurements that is true for a failure.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "n_dup_lines >= 3 AND 100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars > 20 * n_words",
    "capitals": "100 * n_capitals > 50 * word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE_MASK = BIT["few_words"] | BIT["repeated_windows"]
#: Versions of the policy: the bits that reject a document.
POLICIES: dict[str, int] = {"base": BASE_MASK, "v1": BASE_MASK | BIT["symbols"] | BIT["capitals"], "v2": sum(BIT.values())}
POLICY = "v2"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def _repeated_words(hashes: Column, windows: Column) -> Column:
    """Words that stand in a window which occurs twice or more; the sort runs only where one does."""
    last = F.size(windows) - 1
    by_hash = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    same = lambda s, k, j: s.getItem(k)["x"] == s.getItem(j)["x"]
    again = lambda s: F.filter(F.sequence(F.lit(0), last), lambda k: F.when(k > 0, same(s, k, k - 1)).otherwise(F.lit(False)) | F.when(k < last, same(s, k, k + 1)).otherwise(F.lit(False)))
    places = _let(by_hash, lambda s: F.sort_array(F.transform(again(s), lambda k: s.getItem(k)["i"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["total"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("total"))
    covered = F.aggregate(places, start, step, lambda a: a["total"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0).cast("long"))


def measurements(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals) of whole texts."""
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = text.select("doc_id", "text", F.filter(F.split("text", GAPS), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    sizes = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(CAPITALS)).cast("long").alias("n_capitals"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    h, n = F.col("h"), F.size("h")
    windows = sizes.withColumn("g", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[h.getItem(i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    return windows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", _repeated_words(h, F.col("g")).alias("n_repeat_words"), "n_lines", "n_capitals")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements of each row of ``docs`` (doc_id, text) and ``failed_bits``, one bit for each rule of RULES.

    Null and empty texts measure zero and fail ``few_words``; texts of any length are read whole. Rows
    are independent: repeated rows and null doc_ids are kept as they are; other columns, whatever
    their names, are not read, and an empty table gives no row.
    """
    found = measurements(docs)
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return found.withColumn("failed_bits", bits.cast("long"))


def apply_policy(book: DataFrame, version: str = POLICY) -> DataFrame:
    """Adds base_failed and kept, the verdict of a policy version, to each row of a ledger; it reads the bits alone, so an empty ledger, nulls elsewhere and repeated rows need no care."""
    fails = lambda mask: F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")) != 0
    return book.withColumn("base_failed", fails(BASE_MASK)).withColumn("kept", ~fails(BASE_MASK) & ~fails(POLICIES[version]))


def ablations(book: DataFrame, version: str = POLICY) -> DataFrame:
    """(rule, n_failed, n_alone): rows a rule fails, and rows that only this rule of the policy rejects.

    One aggregation counts the distinct bit patterns (at most 2 to the number of rules); the rest
    reads those counts. Repeated rows of the ledger count each; of an empty one there is no row.
    """
    mask = POLICIES[version]
    patterns = book.groupBy("failed_bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask])).alias("r")
    each = patterns.select("failed_bits", "n", rules)
    hit = F.col("failed_bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")) == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_alone"))


def keep_clean(docs: DataFrame, version: str = POLICY) -> DataFrame:
    """The rows of ``docs``, all columns, that the policy keeps; the verdict is taken within the row.

    Null, empty and very short texts go, very long ones are judged whole, repeated rows are judged alike, columns of any
    names are passed on, and an empty table stays empty.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")
    # A filter would be pushed below the measurements and repeat them for each of their uses; it stays above a row number.
    book = apply_policy(ledger(whole), version).select("doc_id", "kept", F.monotonically_increasing_id().alias("row"))
    return book.filter("kept AND row >= 0").select("doc_id.*")


OP2_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM d) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
      CAST(length(text) - length(regexp_replace(text, '[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}]', '', 'g')) AS BIGINT) AS n_capitals
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
      + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
      + (CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_capitals > 50 * word_chars THEN 32 ELSE 0 END) AS BIGINT) AS failed_bits FROM m)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""
