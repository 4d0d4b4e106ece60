"""Ranks within groups, however large a group: rows are dealt by range, and a row's rank is what its range starts with and its place in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .timeline import running

#: Ranges of the ordering column.
RANGES = 64


def rank_in(rows: DataFrame, key: list[str], by: str, ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``rank``, from 0 by ``by`` within ``key``, where no value repeats, and ``size``, the rows of the key.

    The ranges are quantiles of ``by`` over all rows. A window sorts one range of one key; what lies before a range is a sum
    over at most ``ranges`` counts.
    """
    marks = rows.select(F.percentile_approx(by, [k / ranges for k in range(1, ranges)], 100 * ranges)).scalar()
    dealt = rows.withColumn("marks", marks).withColumn("range", F.coalesce(F.array_size(F.filter("marks", lambda m: m < F.col(by))), F.lit(0))).drop("marks")
    counts = dealt.groupBy(*key, "range").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*key)
    starts = counts.select(*key, "range", F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("size"))
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy(*key, "range").orderBy(by)) - 1)
    met = placed.join(starts, [*key, "range"])
    return met.select(*rows.columns, (F.col("start") + F.col("place")).alias("rank"), "size")


def rank_down(rows: DataFrame, key: list[str], score: str, tie: str, ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``rank``, from 0 by the largest ``score`` and of equal ones by the largest ``tie``, and ``size``.

    Equal scores are a group of their own for ``tie``, so that a score which many rows have is no one task's work.
    """
    equal = rank_in(rows, [*key, score], tie, ranges).withColumnRenamed("size", "equal").withColumnRenamed("rank", "below")
    counts = rows.groupBy(*key, score).agg(F.count("*").alias("upto"))
    lowest, highest = rows.select(F.min(score)).scalar(), rows.select(F.max(score)).scalar()
    width = F.greatest((highest - lowest) / ranges, F.lit(1e-12))
    upto = running(counts, [*key], score, ["upto"], width)
    sizes = rows.groupBy(*key).agg(F.count("*").alias("size"))
    met = equal.join(upto, [*key, score]).join(sizes, key)
    return met.select(*rows.columns, (F.col("size") - F.col("upto") + F.col("equal") - 1 - F.col("below")).alias("rank"), "size")
