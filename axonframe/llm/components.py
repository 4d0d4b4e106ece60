"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One step: links every neighbour (of those that are larger, or not larger) to the smallest one."""
    both = edges.union(edges.select("b", "a")) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("low"))
    met = both.join(low, F.col("a") == F.col("u"))
    out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")) if larger else met.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b); the component is its smallest node.

    Ends when a round changes nothing; ``most`` only guards against a fault, since the number of
    rounds grows with the logarithm of the longest path.
    """
    now = scratch.cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most):
        after = scratch.cut(_stars(_stars(now, True), False), "stars")
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if tuple(sums) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
        seen = tuple(sums)
    raise RuntimeError("the components did not settle")
