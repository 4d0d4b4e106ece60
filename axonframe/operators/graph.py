"""Topologies, lookups and edits of a network's graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.rng import Draws, below, gauss, uniform
from .ranks import rank_in


#: Blocks of a network's nodes on either side of its pairs, and tasks over which tiles of them are dealt.
_TILES, _TASKS = 16, 256


def random_edges(nodes: DataFrame, p: float, seed: str = "er") -> DataFrame:
    """(network_id, src_id, tgt_id): each ordered pair within a network, by chance ``p``.

    A network's pairs are its definition: all are drawn, and only within a network, by an equi-join. They are dealt in tiles of
    a block of sources and a block of targets, so that a large network is no one task's work.
    """
    block, each = F.pmod(F.xxhash64("id"), F.lit(_TILES)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(_TILES - 1)))
    key = ["network_id", "i", "j"]
    a = nodes.select("network_id", F.col("id").alias("src_id"), F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"), F.lit("|")).alias("head"), block.alias("i"), each.alias("j"))
    b = nodes.select("network_id", F.col("id").alias("tgt_id"), F.col("id").cast("string").alias("tail"), each.alias("i"), block.alias("j"))
    met = a.repartition(_TASKS, *key).join(b.repartition(_TASKS, *key).hint("shuffle_hash"), key)
    return met.filter((F.col("src_id") != F.col("tgt_id")) & below(p, F.concat("head", "tail"))).select("network_id", "src_id", "tgt_id")


#: Mean edges drawn from one block of candidates.
_DRAWN = 64


def _skips(batches: Iterator[pa.RecordBatch], p: float) -> Iterator[pa.RecordBatch]:
    """(network_id, src_id, tgt_id) of rows (network_id, id, own, width, head, ends): a source's edges to a block of candidates."""
    for batch in batches:
        own, width = batch.column("own").to_numpy(), batch.column("width").to_numpy()
        draws, going = Draws(batch.column("head")), np.arange(batch.num_rows)
        at, k, hits = np.full(batch.num_rows, -1), 0, []
        while len(going):
            k += 1
            at = at + (np.floor(np.log(1.0 - draws.at(k)) / math.log1p(-p)).astype(np.int64) if p < 1 else 0) + 1
            within = at < width[going]
            hits.append((going[within], at[within]))
            if not within.all():
                going, at = going[within], at[within]
                draws.keep(within)
        if hits:
            row, at = map(np.concatenate, zip(*hits))
            ends = batch.column("ends")
            place = ends.offsets.to_numpy()[row] + at + (at >= own[row])
            yield pa.RecordBatch.from_arrays([batch.column("network_id").take(row), batch.column("id").take(row), ends.values.take(place)], ["network_id", "src_id", "tgt_id"])


def random_edges_by_skips(nodes: DataFrame, p: float, seed: str = "skip") -> DataFrame:
    """(network_id, src_id, tgt_id): each ordered pair within a network, by chance ``p``, with work by the edges drawn and not by the pairs.

    A source's candidates are the other nodes in the order of their ids. The gaps between those it takes are geometric, so
    each draw goes from one edge to the next; candidates come in blocks of 64 / p, so that no row draws for long.
    """
    if p <= 0:
        return nodes.select("network_id", F.col("id").alias("src_id"), F.col("id").alias("tgt_id")).limit(0)
    placed = rank_in(nodes.select("network_id", "id"), ["network_id"], "id")
    block = max(1, math.ceil(_DRAWN / p))
    width = F.least(F.lit(block), F.col("size") - 1 - F.col("block") * block)
    starts = placed.filter("size > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 2) / block)))).withColumn("width", width)
    # A block's candidates have ranks that follow each other, one more than its width as the source itself is none: the ends come as one array a block.
    first = F.floor(F.col("rank") / block)
    within = F.explode(F.when((F.col("rank") % block == 0) & (F.col("rank") > 0), F.array(first, first - 1)).otherwise(F.array(first)))
    ends = placed.select("network_id", "rank", "id", within.alias("block")).groupBy("network_id", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda e: e["id"]).alias("ends"))
    key = ["network_id", "block"]
    starts = starts.select(*key, F.col("id"), F.col("rank").alias("own"), "width").repartition(_TASKS, *key)
    hits = starts.join(ends.repartition(_TASKS, *key).hint("shuffle_hash"), key)
    head = F.concat_ws("|", F.lit(seed), F.col("id").cast("string"), F.col("block").cast("string"))
    met = hits.select("network_id", "id", (F.col("own") - F.col("block") * block).cast("long").alias("own"), F.col("width").cast("long").alias("width"), head.alias("head"), "ends")
    schema = StructType([StructField(c, nodes.schema[of].dataType) for c, of in (("network_id", "network_id"), ("src_id", "id"), ("tgt_id", "id"))])
    return met.mapInArrow(lambda batches: _skips(batches, p), schema)


def small_world(spark: SparkSession, n: int, k: int, beta: float, seed: str = "sw") -> DataFrame:
    """(src_id, tgt_id): a ring lattice whose edges are rewired, by chance ``beta``, to a node that is no neighbour in the lattice.

    The new end is found by a draw over the nodes outside the lattice's neighbourhood, counted round
    the ring, so no edge ever meets all nodes.
    """
    half = k // 2
    reach = max(min(half, (n - 1) // 2), 0)
    lattice = spark.range(n).select(F.col("id").alias("src_id"), F.explode(F.sequence(F.lit(1), F.lit(max(reach, 1)))).alias("j")).filter(F.col("j") <= reach)
    both = lattice.select("src_id", F.explode(F.array(F.pmod(F.col("src_id") + F.col("j"), F.lit(n)), F.pmod(F.col("src_id") - F.col("j"), F.lit(n)))).alias("old")).distinct()
    free = n - 1 - 2 * reach
    moved = (uniform(seed + "m", "src_id", "old") < beta) & F.lit(free > 0)
    new = F.pmod(F.col("src_id") + reach + 1 + F.floor(uniform(seed + "t", "src_id", "old") * max(free, 1)), F.lit(n))
    return both.select("src_id", F.when(moved, new).otherwise(F.col("old")).cast("long").alias("tgt_id")).distinct()


def layered(spark: SparkSession, sizes: list[int], p: float, exc_ratio: float, seed: str = "ff") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, layer, place, neuron_type, excitatory, x, y) and edges (src_id, tgt_id) of a feed-forward network."""
    last, before = len(sizes) - 1, [sum(sizes[:i]) for i in range(len(sizes))]
    layers = spark.createDataFrame([(i, s, b) for i, (s, b) in enumerate(zip(sizes, before))], "layer int, size int, first long")
    nodes = layers.select("layer", "size", (F.explode(F.sequence(F.lit(0), F.col("size") - 1))).alias("place"), "first")
    nodes = nodes.withColumn("id", F.col("first") + F.col("place"))
    exc = (F.col("layer") < last) | (uniform(seed + "x", "id") < exc_ratio)
    kind = F.when(F.col("layer") == 0, "sensory").when(F.col("layer") == last, "motor").when(exc, "pyramidal").otherwise("interneuron")
    x, y = 80 + 640.0 * F.col("layer") / max(last, 1), 60 + 480.0 * F.col("place") / F.greatest(F.col("size") - 1, F.lit(1))
    out = nodes.select("id", "layer", "place", kind.alias("neuron_type"), exc.alias("excitatory"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))
    a, b = nodes.select(F.col("id").alias("src_id"), (F.col("layer") + 1).alias("next")), nodes.select(F.col("id").alias("tgt_id"), F.col("layer").alias("next"))
    return out, a.join(b, "next").filter(uniform(seed + "e", "src_id", "tgt_id") < p).select("src_id", "tgt_id")


def scale_free(networks: DataFrame, m: int = 2) -> DataFrame:
    """(network_id, src_id, tgt_id) for ``networks`` (network_id, n): each new node links to ``m`` nodes, drawn by degree.

    The growth is sequential within a network and parallel over networks.
    """
    import random

    def grow(batches):
        for batch in batches:
            for net, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng, src, tgt = random.Random(net), [], []
                seeds = min(m + 1, n)
                for a in range(seeds):
                    for b in range(seeds):
                        if a != b:
                            src.append(a)
                            tgt.append(b)
                # Each edge end is a ticket: a draw among tickets is a draw by degree.
                tickets = src.copy()
                for node in range(seeds, n):
                    chosen: set[int] = set()
                    for _ in range(10 * n):
                        if len(chosen) == min(m, node):
                            break
                        chosen.add(rng.choice(tickets))
                    for t in sorted(chosen):
                        src.append(node)
                        tgt.append(t)
                        tickets += [node, t]
                yield pa.RecordBatch.from_arrays([pa.array([net] * len(src), pa.int64()), pa.array(src, pa.int64()), pa.array(tgt, pa.int64())], ["network_id", "src_id", "tgt_id"])

    spread = networks.select(F.col("network_id").cast("long").alias("network_id"), F.col("n").cast("long").alias("n")).repartition("network_id")
    return spread.mapInArrow(grow, "network_id long, src_id long, tgt_id long")


def build(spark: SparkSession, config: dict) -> DataFrame:
    """(src_id, tgt_id): the edges of one network as ``config`` describes it; an unknown topology is a random one."""
    n, kind = config.get("n_neurons", 20), config.get("topology", "random")
    if kind == "small_world":
        return small_world(spark, n, config.get("sw_k", 4), config.get("sw_beta", 0.3))
    if kind == "layered":
        return layered(spark, config.get("layer_sizes") or [5, 10, 5], config.get("connect_prob", 0.2), config.get("exc_ratio", 0.8))[1]
    if kind == "scale_free":
        one = spark.range(1).select(F.lit(0).cast("long").alias("network_id"), F.lit(n).cast("long").alias("n"))
        return scale_free(one, config.get("sf_m", 2)).select("src_id", "tgt_id")
    return random_edges(spark.range(n).select("id", F.lit(0).alias("network_id")), config.get("connect_prob", 0.2)).select("src_id", "tgt_id")


def roulette(items: DataFrame, group: str, item: str, weight: str, seed: str = "rw") -> DataFrame:
    """(group, item): one item of each group, drawn by weight along the running sum."""
    run = items.withColumn("upto", F.sum(weight).over(Window.partitionBy(group).orderBy(item).rowsBetween(Window.unboundedPreceding, 0)))
    total = items.groupBy(group).agg((F.sum(weight) * F.first(uniform(seed, group))).alias("mark"))
    return run.join(total, group).filter(F.col("upto") > F.col("mark")).groupBy(group).agg(F.min(item).alias(item))


def circle(nodes: DataFrame, radius: float = 300.0) -> DataFrame:
    """Adds (x, y) on a circle around (400, 300); a node's place is its rank in its network."""
    angle = F.lit(2 * math.pi) * F.col("rank") / F.greatest(F.col("size"), F.lit(1))
    return rank_in(nodes, ["network_id"], "id").withColumn("x", 400 + radius * F.cos(angle)).withColumn("y", 300 + radius * F.sin(angle)).drop("rank", "size")


def with_weights(edges: DataFrame, mean: float = 1.0, std: float = 0.3, furthest: float = 3.0, seed: str = "w") -> DataFrame:
    """Adds a normal weight of 0.05 at least and a uniform distance from 0.1 to ``furthest``."""
    key = ("src_id", "tgt_id")
    return edges.withColumn("weight", F.greatest(F.lit(0.05), mean + std * gauss(seed, *key))).withColumn("distance", 0.1 + (furthest - 0.1) * uniform(seed + "d", *key))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, targets): the sorted targets of every node, empty where it has none."""
    out = edges.groupBy(F.col("src_id").alias("id")).agg(F.sort_array(F.collect_list("tgt_id")).alias("targets"))
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("targets", F.array().cast("array<bigint>")).alias("targets"))


def add_node(nodes: DataFrame, **values) -> DataFrame:
    """``nodes`` and one more, whose id follows the largest; it is placed at (400, 300) if not given a place, and other columns not given are null."""
    values = {"x": 400.0, "y": 300.0} | values
    new = nodes.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("id"))
    return nodes.unionByName(new.select("id", *[F.lit(values.get(c)).cast(t).alias(c) for c, t in nodes.dtypes if c != "id"]))


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids of ``gone`` (id) and the edges at either end."""
    kept = edges
    for end in ("src_id", "tgt_id"):
        kept = kept.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` and those of ``new`` whose ends both exist."""
    for end in ("src_id", "tgt_id"):
        new = new.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return edges.unionByName(new, allowMissingColumns=True)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in)"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("tgt_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").cast("long").alias("n_out"), F.sum("e.i").cast("long").alias("n_in"))
