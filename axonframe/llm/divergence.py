"""How far the sources of a language are apart: shares of kept terms, compared pair by pair and term by term.

One pass over the texts counts (lang, source, term) within the tasks; what is kept are the terms in enough documents
of their language. The dictionary of a language is dealt by hash into slices of about WIDTH terms, and its sources
into blocks of about BLOCK, so that a tile (language, two blocks, slice) is a dense matrix of bounded size however
large the dictionary and however many the sources: within it the slice's terms are a sorted array, ``searchsorted``
gives their ids, and ``bincount`` the vector of each source. Ids keep the order of the terms' UTF-8 bytes, so ties of
terms go by ids. All numbers are integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .scratch import Scratch

MIN_DOCS, SMOOTH, TOP = 30, 5, 50
#: Mean terms in a slice, the least number of slices of a language (a small dictionary is spread too), mean sources in a block.
WIDTH, SLICES, BLOCK = 2048, 32, 64
#: Counters of a task are handed on at so many entries or bytes of text.
ENTRIES, BYTES = 600_000, 48 << 20
#: Letters of ASCII in lower case, every other ASCII character as a space; bytes of longer characters stay.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's documents (lang, source, text): (lang, source, term, n, docs), terms as bytes; more than one row a term is possible."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    taken = entries = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = [b"", *n]  # the empty term stands for the group itself, which may hold no term
            counts = [np.fromiter((x[t] for t in terms), np.int64, len(terms)) for x in (n, docs)]
            same = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(terms, pa.binary()), *map(pa.array, counts)], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
            words = text.translate(_TO_WORDS).split()
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(words)
            docs.update(set(words))
            taken, entries = taken + len(text), entries + len(n) - before
            if taken > BYTES or entries > ENTRIES:
                yield from rows()
                groups, taken, entries = {}, 0, 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and documents (rows) that hold it; every group has an empty term with 0."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(said("lang").alias("lang"), said("source").alias("source"), said("text").cast("binary").alias("text"))
    parts = rows.mapInArrow(_counts, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * count / total) for 0 <= count <= total < 2^53: a long division by three digits of base 1000."""
    rest, out = count.astype(np.int64), np.zeros(np.broadcast(count, total).shape, dtype=np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """A tile's part of the result: differences of source pairs summed over its terms, and the best terms of each source."""
    columns = ["lang", "source", "part", "item", "value"]
    lang, a, b = rows["lang"].iloc[0], int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
    # kind 0: a source, with its sum of counts; 1: a term, with its count in the language; 2: a term's count in a source
    sources, terms, counts = (rows[rows["kind"] == k] for k in (0, 1, 2))
    if not len(sources):  # blocks that got no source
        return pd.DataFrame([], columns=columns).astype({"value": "int64"})
    names = sources["source"].to_numpy()
    order = np.argsort(names)
    names, block, total = names[order], sources["block"].to_numpy()[order], sources["n"].to_numpy()[order]
    own = np.unique(terms["term"].to_numpy()) if len(terms) else np.empty(0, dtype=object)
    size, lang_n, n_terms = len(own), int(sources["lang_n"].iloc[0]), int(sources["n_terms"].iloc[0])
    ids = np.searchsorted(own, counts["term"].to_numpy()) if len(counts) else np.empty(0, dtype=np.int64)
    at = np.searchsorted(names, counts["source"].to_numpy()) if len(counts) else ids
    dense = np.bincount(at * size + ids, weights=counts["n"].to_numpy(dtype=np.float64), minlength=len(names) * size).astype(np.int64).reshape(len(names), size)
    p = shares(dense + SMOOTH, (total + SMOOTH * n_terms)[:, None]) if size else dense
    out = []
    for i in range(len(names)):  # a source against the others of the tile; a pair within one block is in that block's own tile
        other = np.flatnonzero((block != block[i]) if a != b else (np.arange(len(names)) != i))
        if len(other):
            out.append((names[i], "pair", names[other], np.abs(p[other] - p[i]).sum(axis=1)))
    if a == b and size:
        by_id = terms.sort_values("term")["n"].to_numpy()
        q = shares(by_id + SMOOTH, np.array(lang_n + SMOOTH * n_terms))
        for i in range(len(names)):
            over = np.flatnonzero((dense[i] > 0) & (p[i] > q))
            gain = p[i][over] - q[over]
            best = over[np.lexsort((over, -gain))[:TOP]]
            out.append((names[i], "term", own[best], p[i][best] - q[best]))
    flat = [(lang, source, part, item, int(value)) for source, part, items, values in out for item, value in zip(items, values)]
    return pd.DataFrame(flat, columns=columns).astype({"value": "int64"})


def audit(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, width: int = WIDTH, least: int = SLICES, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group (lang, source) that occurs in ``docs`` (lang, source, text).

    Null lang, source and text are empty text, and empty text is a language or a source like any other; each row is a
    document, repeated rows too. Part ``pair`` has all other sources of the language, with 0 where the language keeps no
    term, so a language with one source has none; part ``term`` has the TOP best kept terms whose share in the group is
    above the one in the language. Ties go by the item's UTF-8 bytes. An empty table gives no row. Texts and terms are
    taken whole; other columns are not read. Sums of counts are held to be under 2^53.
    """
    scratch = Scratch(spark, "divergence")
    counted = scratch.cut(term_counts(docs), "counted")
    everywhere = Window.partitionBy("lang", "term")  # at most as many rows as the language has sources
    kept = counted.withColumn("in_docs", F.sum("docs").over(everywhere)).filter(F.col("in_docs") >= min_docs).withColumn("term_n", F.sum("n").over(everywhere))
    kept = scratch.cut(kept.select("lang", "source", "term", "n", "term_n"), "kept")
    occurring = counted.select("lang", "source").distinct()

    terms = kept.groupBy("lang", "term").agg(F.max("term_n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n").alias("lang_n"))
    groups = occurring.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").na.fill(0, ["n"])
    sized = groups.groupBy("lang").agg(F.count("*").alias("n_sources")).join(langs, "lang", "left").na.fill(0, ["n_terms", "lang_n"])
    sized = sized.select("lang", "n_terms", "lang_n", F.greatest(F.lit(least), F.ceil(F.col("n_terms") / width)).alias("slices"), F.ceil(F.col("n_sources") / block).alias("blocks"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    groups = scratch.cut(groups.join(sized, "lang").withColumn("block", dealt("source", "blocks")), "groups")

    up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    both = lambda df: df.withColumn("y", F.explode(up_to("blocks"))).withColumn("a", F.least("block", "y")).withColumn("b", F.greatest("block", "y"))
    no_text, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    key = ("lang", "a", "b", "slice")
    heads = both(groups.withColumn("slice", F.explode(up_to("slices")))).select(*key, F.lit(0).alias("kind"), "source", no_text.alias("term"), "n", "block", "lang_n", "n_terms")
    places = terms.join(sized, "lang").withColumn("slice", dealt("term", "slices")).withColumn("a", F.explode(up_to("blocks"))).withColumn("b", F.explode(F.sequence("a", F.col("blocks") - 1)))
    words = places.select(*key, F.lit(1).alias("kind"), no_text.alias("source"), "term", "n", none.alias("block"), none.alias("lang_n"), none.alias("n_terms"))
    found = both(kept.join(groups.select("lang", "source", "block", "blocks", "slices"), ["lang", "source"]).withColumn("slice", dealt("term", "slices")))
    found = found.select(*key, F.lit(2).alias("kind"), "source", "term", "n", none.alias("block"), none.alias("lang_n"), none.alias("n_terms"))
    tiles = heads.unionByName(words).unionByName(found).groupBy(*key).applyInPandas(_tile, "lang string, source string, part string, item string, value long")
    tiles = scratch.cut(tiles, "tiles")
    scratch.drop(counted, kept, groups)

    pairs = tiles.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.unionByName(tiles.filter("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return ranked.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= TOP))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT row, lang, source, unnest(ws) AS term FROM d),
t AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM t GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN t USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + {SMOOTH})) // (coalesce(s.n, 0) + {SMOOTH} * v.v) AS p, 1 + (1000000000 * (t.n + {SMOOTH})) // (v.n + {SMOOTH} * v.v) AS q
  FROM g JOIN t ON t.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}
"""
