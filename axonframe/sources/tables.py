"""The engine's entity tables, read from Parquet: neurons, populations, spikes, synapses, stimuli, genomes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.packs import packed, unpack
from ..functions.presets import GENES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def neurons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, network_id, neuron_type, model, excitatory)"""
    i = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("pyramidal", "interneuron", "motor", "sensory", "purkinje", "granule"))), (i % 6 + 1).cast("int"))
    model = F.when(i % 18 < 6, "izh").when(i % 18 < 12, "lif").otherwise("hh")
    return table(spark, sf_dir, "supplier").select(i.alias("id"), (i % 5).alias("network_id"), kind.alias("neuron_type"), model.alias("model"), (~(i % 6).isin(1, 4)).alias("excitatory"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, network_id, excitatory, v)"""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("network_id"), (F.col("c_custkey") % 5 != 0).alias("excitatory"), F.col("c_acctbal").alias("v"))


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(neuron_id, t_ms)"""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("neuron_id"), F.col("event_id").cast("double").alias("t_ms"))


#: What tells a pair's first line, and blocks of pairs.
_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
_PAIRS = 256


def _first_lines(block: pa.Table, kept: list[str]) -> pa.Table:
    """The first line of each pair of a block; only pairs that have several lines are sorted by all that tells them apart."""
    lines = unpack(block["pack"])
    src, tgt = lines["src_id"].to_numpy(), lines["tgt_id"].to_numpy()
    order = np.lexsort((tgt, src))

    def heads(order):
        return np.flatnonzero(np.append(True, (np.diff(src[order]) != 0) | (np.diff(tgt[order]) != 0)))

    at = heads(order)
    n = np.diff(np.append(at, len(order)))
    several = order[np.repeat(n > 1, n)]
    if len(several):
        of = lines.take(several)
        several = several[pc.sort_indices(of, [(c, "ascending") for c in ("src_id", "tgt_id", *_ORDER)]).to_numpy()]
        several = several[heads(several)]
    return lines.take(np.append(order[at[n == 1]], several)).select(kept)


def synapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_id, tgt_id, weight, distance, syn_type); one row for each pair, the first by the order lines.

    Lines travel in packs to the block of their pair, as they are many and wide.
    """
    size = table(spark, sf_dir, "supplier").select(F.count("*")).scalar()
    kind = F.when(F.col("l_returnflag") == "A", "ampa").when(F.col("l_returnflag") == "R", "gaba_a").when(F.col("l_linestatus") == "F", "nmda").otherwise("gaba_b")
    tgt = F.col("l_partkey") % size
    block = F.pmod(F.xxhash64("l_suppkey", tgt), F.lit(_PAIRS)).cast("int")
    # Parts of one target differ by multiples of the size, which are in the same order and repeat.
    part = (F.col("l_partkey") - tgt).alias("l_partkey")
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_suppkey") != tgt).select(F.col("l_suppkey").alias("src_id"), tgt.alias("tgt_id"), *[part if c == "l_partkey" else c for c in _ORDER], block.alias("block"))
    kept = ["src_id", "tgt_id", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
    schema = StructType([rows.schema[c] for c in kept])
    first = packed(rows, "src_id").groupBy("block").applyInArrow(lambda lines: _first_lines(lines, kept), schema)
    return first.select("src_id", "tgt_id", (F.col("l_quantity") / 10).alias("weight"), (F.lit(0.1) + F.col("l_discount") * 29).alias("distance"), kind.alias("syn_type"))


def stimuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stim_id, neuron_id, stim_type, amplitude, duration_ms, frequency, start_t)"""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind = F.when(F.col("event_type") == "click", "pulse").when(F.col("event_type") == "view", "ramp").when(F.col("event_type") == "purchase", "constant").when(F.col("event_type") == "signup", "sinusoidal").otherwise("random")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("stim_id"), F.col("user_id").alias("neuron_id"), kind.alias("stim_type"), F.least("value", F.lit(30.0)).alias("amplitude"), (5 + 5 * k).cast("double").alias("duration_ms"), (1 + k).cast("double").alias("frequency"), F.col("event_id").cast("double").alias("start_t"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, op, id, src_id, tgt_id, weight): the log of edits, a command for each event."""
    op = F.when(F.col("event_type") == "click", "add_synapse").when(F.col("event_type") == "view", "update_synapse").when(F.col("event_type") == "purchase", "remove_synapse").when(F.col("event_type") == "signup", "add_neuron").otherwise("remove_neuron")
    tgt = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("id"), F.col("user_id").alias("src_id"), tgt.alias("tgt_id"), F.least(F.col("value") / 50, F.lit(10.0)).alias("weight"))


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, genome): as many elements as there are genes."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice("embedding", 1, len(GENES)).cast("array<double>").alias("genome"))
