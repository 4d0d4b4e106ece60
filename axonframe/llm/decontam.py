"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question asked anew with other values
keeps its template. Windows of template tokens of the documents are hash-joined with those of the
benchmark items; where they meet, the values in the slots are compared: one benchmark value must
stand for one document value throughout an alignment, else the match is by chance.

A bitmap of fixed size (2**MAP_BITS bits, built from all benchmark windows) goes to the tasks and
spares the join most windows of the documents; it loses none, and what it lets through in vain the
join drops.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch
from .textkernel import LOWER, SOFT_GAP, find_words, hash_spans, hash_windows, sentence_numbers, text_blocks

WINDOW = 8
#: Words of a window that are no placeholders, at least.
LITERAL = 4
#: A match needs so many windows of an item, or all of them if it has fewer.
MIN_WINDOWS = 2
#: Items of fewer words say little by themselves: they match only where they are a whole line.
WHOLE_LINE = 5
MAP_BITS = 24
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x1F3D5B79A6C8E0F1, 0x2E4C6A8F0B1D3F57, 0x3D5B7F9182A4C6E8))
#: Units that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec ms min h hr hours minutes seconds days weeks months years meters metres kilometers grams liters miles inches feet dollars cents euros percent % degrees mph kmh".split()

_UNIT_HASHES = hash_spans(np.frombuffer(b" ".join(u.encode() for u in UNITS), np.uint8), *find_words(np.frombuffer(b" ".join(u.encode() for u in UNITS), np.uint8), np.array([0, sum(len(u) + 1 for u in UNITS) - 1]))[:2])


def templates(data: np.ndarray, offs: np.ndarray):
    """(template token, its value, whether it is a slot, index of the first token of each row).

    A number has a digit and no ASCII letter; a unit is a word of UNITS after a number; a name
    starts with a capital and doesn't start a sentence or line.
    """
    lower = LOWER[data]
    starts, ends, at = find_words(lower, offs, SOFT_GAP)
    value = hash_spans(lower, starts, ends)
    if not len(starts):
        return value, value, np.zeros(0, bool), at
    count = lambda mask: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(mask)]))
    digits = (lower >= 48) & (lower <= 57)
    number = (count(digits) > 0) & (count((lower >= 97) & (lower <= 122)) == 0)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    after = np.zeros(len(starts), bool)
    after[1:] = row[1:] == row[:-1]
    prev_number = np.zeros(len(starts), bool)
    prev_number[1:] = number[:-1]
    unit = after & prev_number & np.isin(value, _UNIT_HASHES)
    sentence = sentence_numbers(data)[starts]
    inside = after.copy()
    inside[1:] &= sentence[1:] == sentence[:-1]
    lead, second = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    name = inside & capital & ~number & ~unit
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    return token, value, number | unit | name, at


def _line_edges(data: np.ndarray, offs: np.ndarray):
    """Which words are the first, and which the last, of their line."""
    starts, _, at = find_words(data, offs, SOFT_GAP)
    line, row = np.cumsum(data == 10)[starts], np.repeat(np.arange(len(offs) - 1), np.diff(at))
    new = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    return np.append(True, new)[: len(starts)], np.append(new, True)[: len(starts)]


def _windows(sizes: list[int], bitmap=None):
    """Windows of whole rows, of the ``sizes`` given; with a bitmap only those that it has."""

    def run(batches):
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offs in text_blocks(batch.column(1)):
                token, value, slot, at = templates(data, offs)
                edges = _line_edges(data, offs) if bits is not None and min(sizes) < WHOLE_LINE else None
                filled = np.concatenate([[0], np.cumsum(slot)])
                for size in sizes:
                    h, row, first = hash_windows(token, at, size)
                    keep = (size - (filled[first + size] - filled[first])) * WINDOW >= LITERAL * size
                    if bits is not None:
                        b = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                        keep &= (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 > 0
                        if size < WHOLE_LINE:
                            keep &= edges[0][first] & edges[1][first + size - 1]
                    h, row, first = h[keep], row[keep], first[keep]
                    around = first[:, None] + np.arange(size)
                    flat = pa.array(np.where(slot[around], value[around], np.uint64(0)).view(np.int64).ravel())
                    slots = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * size), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + row]), pa.array(np.full(len(first), size, np.int32)), pa.array(h.view(np.int64)), pa.array((first - at[row]).astype(np.int32)), slots], ["id", "size", "h", "place", "slots"])

    return run


_WINDOW = "id long, size int, h long, place int, slots array<long>"


def _item_sizes(batches):
    for batch in batches:
        counts = [np.diff(find_words(data, offs, SOFT_GAP)[2]) for _, _, data, offs in text_blocks(batch.column(0))]
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(counts)).astype(np.int32))], ["n"])


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, n_slots, exact, place) of every document that holds a benchmark item or part of it.

    ``docs`` has (doc_id, text), ``benchmark`` (item_id, text). Of the alignments of an item with a
    document the one with the most windows counts (the first, in a tie); it must have MIN_WINDOWS
    windows or all of the item's, and consistent slots. ``exact`` tells that every slot holds the
    item's own value. Items of fewer than WINDOW words match as one window, and those of fewer than
    WHOLE_LINE words only where they are a whole line. ``place`` is the number of the document's word at
    which the item's first word would stand, negative if the item's begin is cut off. Null and empty texts
    hold nothing, null ids take no part, repeated rows count once, and other columns are not read.
    """
    scratch = Scratch(spark, "decontam")
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").distinct()
    short = items.select("text").mapInArrow(_item_sizes, "n int").filter(F.col("n").between(1, WINDOW - 1)).distinct().collect()
    sizes = sorted({WINDOW, *(r.n for r in short)})
    own = scratch.cut(items.mapInArrow(_windows(sizes), _WINDOW), "items")
    # Sizes below WINDOW are for items that have no more words than that.
    longest = own.groupBy("id").agg(F.max("size").alias("size"))
    own = scratch.cut(own.join(longest, ["id", "size"]), "own")
    word = F.shiftrightunsigned("h", 64 - MAP_BITS)
    bits = own.groupBy(F.shiftright(word, 3).cast("int").alias("b")).agg(F.bit_or(F.expr("shiftleft(1, cast(" + f"shiftrightunsigned(h, {64 - MAP_BITS}) & 7 as int))")).alias("m")).toArrow()
    bitmap = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    bitmap[bits["b"].to_numpy()] = bits["m"].to_numpy().astype(np.uint8)
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    held = docs.mapInArrow(_windows(sizes, shared), _WINDOW)
    met = held.alias("d").join(own.alias("o"), (F.col("d.h") == F.col("o.h")) & (F.col("d.size") == F.col("o.size")))
    pairs = F.filter(F.arrays_zip(F.col("o.slots").alias("own"), F.col("d.slots").alias("met")), lambda p: p["own"] != 0)
    met = met.select(F.col("d.id").alias("doc_id"), F.col("o.id").alias("item_id"), (F.col("d.place") - F.col("o.place")).alias("shift"), F.col("o.place").alias("place"), pairs.alias("pairs")).distinct()
    lined = met.groupBy("doc_id", "item_id", "shift").agg(F.count("*").alias("n_windows"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.min("place").alias("place"))
    values = F.size(F.array_distinct(F.transform("pairs", lambda p: p["own"])))
    lined = lined.filter(values == F.size("pairs"))
    best = lined.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", (-F.col("shift")).alias("back"), F.size("pairs").cast("long").alias("n_slots"), F.forall("pairs", lambda p: p["own"] == p["met"]).alias("exact"))).alias("x"))
    total = own.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct("place").alias("item_windows"))
    out = best.join(total, "item_id").select("doc_id", "item_id", F.col("x.n_windows").alias("n_windows"), "item_windows", F.col("x.n_slots").alias("n_slots"), F.col("x.exact").alias("exact"), (-F.col("x.back")).alias("place"))
    return out.filter(F.col("n_windows") >= F.least(F.lit(MIN_WINDOWS), F.col("item_windows")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose doc_id is not contaminated; null ids and null texts stay, and all rows of a contaminated doc_id go."""
    bad = contaminated(spark, docs, benchmark).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__id"], "left_anti")
