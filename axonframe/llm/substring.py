"""Repeated passages: lines, paragraphs and runs of words are hashed, and all but the earliest occurrence go.

Units are lines, paragraphs of several lines, and runs of whole sentences from each sentence on, up
to the first sentence end that makes ``MIN_WORDS`` words; shorter ones are none. Besides these, seeds of ``SEED`` words stand anywhere and run over line breaks: of each ``AMONG`` successive starts
the one with the least hash is taken, so two equal runs of ``RUN`` words or more have a seed in common,
and seeds lie close enough to overlap. What such a run has before its first or after its last seed is
less than ``AMONG`` words; where the found seeds end, every occurrence of them is read anew and all
windows of ``SEED`` words there are compared, so the whole run is found. Shorter lines are often
headings and licence lines; ``MIN_WORDS`` is a parameter.

Words are normalised (A-Z lower-cased, white space and ``.,;:!?"()[]{}`` between words left out).
Digests are grouped over the whole corpus: 64 bits are counted first, and a bitmap of fixed size
(``2**MAP_BITS`` bits) of those that repeat spares all later steps the units that stand once; what it
lets through in vain, the full 128 bits tell apart. The two halves of a digest come from different
hashes of the words. The occurrence that is first by (doc_id, start) stays; the others are given with
their code-point offsets in the original text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .scratch import Scratch
from .textkernel import LOWER, SOFT_GAP, code_points, find_words, hash_runs, hash_spans, mix64, sentence_numbers, text_blocks

MIN_WORDS = 16
#: Every repeated run of so many words is found whole.
RUN = 50
SEED = 33
AMONG = RUN - SEED + 1
MAP_BITS = 26
#: A digest with more than one of so many parts of all units is hot: there are no more hot ones than parts.
PARTS = 1 << 16
#: Rows (of a few dozen bytes) of a table that is broadcast at most; its size is counted first.
SENT = 50_000
_UNIT = "d1 long, d2 long, doc_id long, start int, end int, n_words int, key int, pos int, rest int"


def _second(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Word hashes that do not follow from the first ones: those of the bytes turned round."""
    turned = (data >> np.uint8(3)) | (data << np.uint8(5))
    return mix64(hash_spans(turned, starts, ends) ^ np.uint64(0x5DEECE66D))


def _batch(ids, keys, begin, end, row, pos, rest, words, others, cp, starts, ends, offs):
    """Units of words [begin, end); ``pos`` is null for those that are no runs of SEED words."""
    base = cp[offs[row]]
    whole = lambda x: pa.array(x.astype(np.int32))
    digests = [pa.array(hash_runs(w, begin, end).view(np.int64)) for w in (words, others)]
    places = [whole(cp[starts[begin]] - base), whole(cp[ends[end - 1]] - base), whole(end - begin)]
    return pa.RecordBatch.from_arrays(
        [*digests, pa.array(ids), *places, pa.array(keys), pa.array(pos, pa.int32()), pa.array(rest, pa.int32())],
        ["d1", "d2", "doc_id", "start", "end", "n_words", "key", "pos", "rest"],
    )


def _seeds(words, row, at):
    """First words of the seeds: the least hash, the last of equal ones, among each AMONG starts in a row."""
    begin = np.flatnonzero(np.arange(len(words)) + SEED <= at[1:][row])
    if len(begin) < AMONG:
        return begin[:0]
    hashes = hash_runs(words, begin, begin + SEED)
    least = np.arange(len(begin) - AMONG + 1) + AMONG - 1 - np.argmin(np.lib.stride_tricks.sliding_window_view(hashes, AMONG)[:, ::-1], axis=1)
    return begin[np.unique(least[row[begin[: len(least)]] == row[begin[AMONG - 1 :]]])]


def _blocks(data, starts, row):
    """First and last words of the lines, of the paragraphs that have several lines, and of the runs of whole sentences within a line."""
    breaks, sentence = np.cumsum(data == 10)[starts], sentence_numbers(data)[starts]
    new_row = np.append(True, row[1:] != row[:-1])
    new_line = new_row | np.append(True, breaks[1:] != breaks[:-1])
    new_part = new_row | np.append(True, breaks[1:] > breaks[:-1] + 1)
    new_sentence = new_line | np.append(True, sentence[1:] != sentence[:-1])
    out = []
    for new in (new_line, new_part, new_sentence):
        begin = np.flatnonzero(new)
        out.append((begin, np.append(begin[1:], len(starts))))
    (line, line_end), (part, part_end), (begin, stops) = out
    several = np.searchsorted(line, part_end) - np.searchsorted(line, part) > 1
    # From each sentence to the first sentence end that leaves enough words behind, within the line.
    end = stops[np.minimum(np.searchsorted(stops, begin + MIN_WORDS), len(stops) - 1)]
    line_of = np.cumsum(new_line)[begin] - 1
    whole = (end < line_end[line_of]) | (end == line_end[line_of]) & (begin > line[line_of])  # else it is the line's own
    begin, end = np.concatenate([line, part[several], begin[whole]]), np.concatenate([line_end, part_end[several], end[whole]])
    long = end - begin >= MIN_WORDS
    return begin[long], end[long]


def _found_units(data, offs):
    """Of a block of texts: words, rows, and the units as (begin, end, whether a seed)."""
    lower = LOWER[data]
    starts, ends, at = find_words(lower, offs, SOFT_GAP)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    words = hash_spans(lower, starts, ends)
    if not len(starts):
        return lower, starts, ends, at, row, words, starts, starts, starts > 0
    begin, end = _blocks(data, starts, row)
    seeds = _seeds(words, row, at)
    return lower, starts, ends, at, row, words, np.concatenate([begin, seeds]), np.concatenate([end, seeds + SEED]), np.arange(len(begin) + len(seeds)) >= len(begin)


def _digests(batches):
    """The 64-bit digests of all units."""
    for batch in batches:
        for _, _, data, offs in text_blocks(batch.column(0)):
            _, _, _, _, _, words, begin, end, _ = _found_units(data, offs)
            if len(begin):
                yield pa.RecordBatch.from_arrays([pa.array(hash_runs(words, begin, end).view(np.int64))], ["d1"])


def _units(bitmap):
    """The units whose digests the bitmap has."""

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for i, _, data, offs in text_blocks(batch.column(1)):
                lower, starts, ends, at, row, words, begin, end, seed = _found_units(data, offs)
                if not len(begin):
                    continue
                place = hash_runs(words, begin, end) >> np.uint64(64 - MAP_BITS)
                held = np.flatnonzero((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
                begin, end, seed = begin[held], end[held], seed[held]
                first, own = at[row[begin]], row[begin]
                pos = pa.array(begin - first, pa.int32(), mask=~seed)
                rest = pa.array(at[own + 1] - SEED - begin, pa.int32(), mask=~seed)
                yield _batch(ids[i + own], keys[i + own], begin, end, own, pos, rest, words, _second(lower, starts, ends), code_points(data), starts, ends, offs)

    return run


def _edges(batches):
    """(doc_id, text, key, seeds: list of (pos, left, right)): the windows of SEED words beside the seeds."""
    for batch in batches:
        ids, keys, seeds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3)
        for i, j, data, offs in text_blocks(batch.column(1)):
            lower = LOWER[data]
            starts, ends, at = find_words(lower, offs, SOFT_GAP)
            words, others, cp = hash_spans(lower, starts, ends), _second(lower, starts, ends), code_points(data)
            begin, row = [], []
            for k in range(i, j):
                z = seeds[k].values
                pos, last = z.field("pos").to_numpy(), at[k - i + 1] - at[k - i] - SEED
                near = np.zeros(last + 1, bool)
                for side, step in (("left", -1), ("right", 1)):
                    p = pos[z.field(side).to_numpy(zero_copy_only=False)]
                    near[(p[:, None] + step * np.arange(AMONG)).clip(0, last).ravel()] = True
                begin.append(at[k - i] + np.flatnonzero(near))
                row.append(np.full(len(begin[-1]), k - i))
            begin, row = np.concatenate(begin), np.concatenate(row)
            yield _batch(ids[i + row], keys[i + row], begin, begin + SEED, row, begin - at[row], at[row + 1] - SEED - begin, words, others, cp, starts, ends, offs)


def _repeated_bits(given: DataFrame) -> bytes:
    """The bitmap of the 64-bit digests that two units or more have."""
    twice = given.select("text").mapInArrow(_digests, "d1 long").groupBy("d1").agg(F.count("*").alias("n")).filter("n > 1")
    place = F.shiftrightunsigned("d1", 64 - MAP_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(d1, {64 - MAP_BITS}) & 63 as int))")
    found = twice.groupBy(F.shiftright(place, 6).cast("int").alias("w")).agg(F.bit_or(bit).alias("x")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bits[found["w"].to_numpy()] = found["x"].to_numpy().view(np.uint64)
    return bits.tobytes()


def _join_digests(units: DataFrame, few: DataFrame, hot: DataFrame) -> DataFrame:
    """``units`` and ``few`` by (d1, d2); units of hot digests stay where they are, and the others are shuffled."""
    key = ["d1", "d2"]
    hot = F.broadcast(hot)
    own = units.join(F.broadcast(few.join(hot, key, "left_semi")), key)
    return own.unionByName(units.join(hot, key, "left_anti").join(few.join(hot, key, "left_anti"), key))


def _found(met: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The units that an earlier one equals, with kept_doc_id and kept_start, and the hot digests.

    A unit that overlaps the earliest one in the same text is no repetition of it.
    """
    first = met.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "start", "end", "key")).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    first = scratch.cut(first.select("d1", "d2", "n", *[F.col(f"kept.{c}").alias(f"kept_{c}") for c in ("doc_id", "start", "end", "key")]), "first")
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = scratch.cut(first.filter(F.col("n") > total // PARTS + (1 << 12)).select("d1", "d2"), "hot")
    met = _join_digests(met, first.drop("n"), hot)
    found = met.filter("doc_id <> kept_doc_id OR start >= kept_end OR (key <> kept_key AND start <> kept_start)")
    found = scratch.cut(found.drop("kept_end", "kept_key"), "found")
    scratch.drop(first)
    return found, hot


def repeated_passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, n_words, kept_doc_id, kept_start, digest) of every unit of ``docs`` (doc_id, text) that an earlier one equals.

    The rows of a document cover every run of ``RUN`` words or more that stands earlier. Offsets count
    code points, end exclusive; units of one document may overlap. Null and empty texts have no units
    and rows with a null doc_id take no part. Rows repeated whole (one doc_id and text) count once; a
    repeated doc_id with different texts is ranked by its offsets. Other columns are not read, an
    empty table gives no rows, and texts of any length are read whole.
    """
    scratch = Scratch(spark, "substring")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("key", F.hash("text"))
    bitmap = spark.sparkContext.broadcast(_repeated_bits(given))
    met = scratch.cut(given.mapInArrow(_units(bitmap), _UNIT), "met")
    bitmap.destroy()
    found, hot = _found(met, scratch)
    # Ends of the stretches that found seeds cover, and the seeds from which such an end is near.
    doc = Window.partitionBy("doc_id", "key").orderBy("pos")
    chain = found.filter("pos IS NOT NULL").withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(doc) > SEED).cast("int"), F.lit(0)))
    chain = chain.withColumn("chain", F.sum("new").over(doc))
    whole = Window.partitionBy("doc_id", "key", "chain")
    chain = chain.withColumn("lo", F.min("pos").over(whole)).withColumn("hi", F.max("pos").over(whole))
    chain = chain.withColumn("left", F.col("lo") > F.greatest(F.lit(0), F.col("pos") - AMONG + 1)).withColumn("right", F.col("hi") < F.col("pos") + F.least(F.lit(AMONG - 1), F.col("rest")))
    ends = scratch.cut(chain.filter("left OR right").groupBy("d1", "d2").agg(F.max("left").alias("left"), F.max("right").alias("right")), "ends")
    seeds = _join_digests(met.filter("pos IS NOT NULL").select("d1", "d2", "doc_id", "key", "pos"), ends, hot)
    beside = scratch.cut(seeds.groupBy("doc_id", "key").agg(F.collect_set(F.struct("pos", "left", "right")).alias("seeds")), "beside")
    scratch.drop(met)
    near = F.broadcast(beside) if (beside.agg(F.sum(F.size("seeds"))).first()[0] or 0) <= SENT else beside  # else the texts are shuffled
    edges = scratch.cut(given.join(near, ["doc_id", "key"]).select("doc_id", "text", "key", "seeds").mapInArrow(_edges, _UNIT), "edges")
    found = found.unionByName(_found(edges, scratch)[0])
    scratch.drop(edges)
    found = found.select("doc_id", "start", "end", "n_words", "kept_doc_id", "kept_start", "d1", "d2").dropDuplicates(["doc_id", "start", "end", "d1", "d2"])
    digest = F.concat(F.lower(F.lpad(F.hex("d1"), 16, "0")), F.lower(F.lpad(F.hex("d2"), 16, "0"))).alias("digest")
    return found.select("doc_id", "start", "end", F.col("n_words").cast("long").alias("n_words"), "kept_doc_id", "kept_start", digest)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, removed: str = "removed") -> DataFrame:
    """``docs`` with the repeated units cut out of the texts, and ``removed``, the merged spans in original offsets.

    Rows with a null doc_id or text stay as they are, with no spans; rows that share a doc_id lose
    the same spans. Columns are passed on whatever their names; ``removed`` may be named otherwise.
    """
    spans = repeated_passages(spark, docs).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = rows.join(spans, F.col("row")["doc_id"].cast("long") == F.col("doc_id"), "left")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    joined = lambda a, s: F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    grow = lambda a, s: F.when((F.size(a) > 0) & (last(a)["end"] >= s["start"]), joined(a, s)).otherwise(F.concat(a, F.array(s)))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    merged = met.withColumn("gone", F.aggregate(F.coalesce("spans", empty), empty, grow))
    text = F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["text"], F.substring(text, a["at"] + 1, s["start"] - a["at"])).alias("text"))
    cut = F.aggregate("gone", begin, step, lambda a: F.concat(a["text"], F.substring(text, a["at"] + 1, F.length(text))))
    new_text = F.when(F.size("gone") > 0, cut).otherwise(F.col("row")["text"])
    others = [F.col("row")[c].alias(c) if c != "text" else new_text.alias("text") for c in docs.columns if c != removed]
    return merged.select(*others, F.col("gone").alias(removed))
