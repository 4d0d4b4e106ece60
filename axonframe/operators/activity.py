"""Delivery of spikes, currents, plasticity, rates and the statistics made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import kernels


def cable(edges: DataFrame, axons: DataFrame) -> DataFrame:
    """``edges`` with length, attenuation and delay_ms by the source's axon (id, axon_diameter, myelinated)."""
    met = edges.join(axons.select(F.col("id").alias("src_id"), "axon_diameter", "myelinated"), "src_id")
    d, m = F.col("axon_diameter"), F.col("myelinated")
    met = met.withColumn("length", kernels.space_constant(d, m))
    return met.withColumn("attenuation", kernels.attenuation(F.col("distance"), F.col("length"))).withColumn("delay_ms", kernels.delay(F.col("distance"), kernels.velocity(d, m)))


def deliver(spikes: DataFrame, wires: DataFrame) -> DataFrame:
    """(src_id, tgt_id, t_ms, arrive_t, strength): every spike along every one of the ``wires`` (src_id, tgt_id, delay_ms, strength) of its neuron."""
    met = spikes.withColumnRenamed("neuron_id", "src_id").join(wires, "src_id")
    return met.select("src_id", "tgt_id", "t_ms", (F.col("t_ms") + F.col("delay_ms")).alias("arrive_t"), "strength")


def synaptic_input(edges: DataFrame, kinds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, current): the sum over incoming edges of -g (v - e_rev) / 1000, with g = g_max * weight."""
    met = edges.join(F.broadcast(kinds), "syn_type").join(nodes.select(F.col("id").alias("tgt_id"), "v"), "tgt_id")
    return met.groupBy(F.col("tgt_id").alias("id")).agg(F.sum(-F.col("g_max") * F.col("weight") * (F.col("v") - F.col("e_rev")) * 1e-3).alias("current"))


def last_spikes(spikes: DataFrame, at: Column | float) -> DataFrame:
    """(id, last_t, fired): each neuron's last spike up to ``at``, and whether it is at ``at``."""
    return spikes.filter(F.col("t_ms") <= at).groupBy(F.col("neuron_id").alias("id")).agg(F.max("t_ms").alias("last_t")).withColumn("fired", F.col("last_t") == at)


def clamped(weight: Column) -> Column:
    """A weight within [0, 10]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), weight))


def plasticity(edges: DataFrame, last: DataFrame, at: Column | float, up: float = 0.01, down: float = 0.012, tau: float = 20.0, hebbian: bool = False) -> DataFrame:
    """``edges`` with weights moved by the spikes at ``at`` and kept within [0, 10].

    A source that fires alone strengthens an edge, a target that fires alone weakens it, by the
    time since the other end's last spike; ``hebbian`` swaps the two. If no neuron fires at ``at``,
    nothing is moved or clamped.
    """
    side = lambda end, p: last.select(F.col("id").alias(end), F.col("last_t").alias(f"{p}_t"), F.col("fired").alias(f"{p}_fired"))
    met = edges.join(side("src_id", "s"), "src_id", "left").join(side("tgt_id", "t"), "tgt_id", "left")
    src, tgt = F.coalesce("s_fired", F.lit(False)), F.coalesce("t_fired", F.lit(False))
    trace = lambda t: F.exp(-(at - F.coalesce(t, F.lit(-1e9))) / tau)
    plus, minus = up * trace("t_t"), down * trace("s_t")
    if hebbian:
        plus, minus = -down * trace("t_t"), -up * trace("s_t")
    moved = F.col("weight") + F.when(src & ~tgt, plus).when(tgt & ~src, -minus).otherwise(0.0)
    any_fired = last.select(F.coalesce(F.max("fired"), F.lit(False))).scalar()
    weight = F.when(any_fired, clamped(moved)).otherwise(F.col("weight"))
    return met.select(*[c for c in edges.columns if c != "weight"], weight.alias("weight"))


def clock(t: Column | float) -> Column:
    """A time in ms as a column."""
    return t if isinstance(t, Column) else F.lit(float(t))


def rates(nodes: DataFrame, spikes: DataFrame, t: Column | float) -> DataFrame:
    """``nodes`` with n_spikes and rate (Hz over the whole run); silent neurons have zero."""
    counts = spikes.groupBy(F.col("neuron_id").alias("id")).agg(F.count("*").alias("n_spikes"))
    met = nodes.join(counts, "id", "left").withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)).cast("long"))
    return met.withColumn("rate", F.col("n_spikes") / F.greatest(clock(t), F.lit(1.0)) * 1000.0)


def synchrony() -> Column:
    """1 - min(1, deviation / mean) over rates rounded to two places; 1 for a single neuron."""
    r = F.round("rate", 2)
    return F.when(F.count("*") <= 1, 1.0).otherwise(1.0 - F.least(F.lit(1.0), F.stddev_pop(r) / (F.avg(r) + 1e-6)))


#: The fitness functions by their names, over rows of rates (rate, n_spikes) and the network's weight (total_weight).
FITNESS = {
    "max_firing_rate": lambda: F.avg("rate"),
    "target_20hz": lambda: -F.abs(F.avg("rate") - 20.0),
    "target_10hz": lambda: -F.abs(F.avg("rate") - 10.0),
    "synchrony": lambda: F.round(synchrony(), 3),
    "diversity": lambda: F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop("rate") / (F.avg("rate") + 1e-6)),
    "efficiency": lambda: F.sum("n_spikes") / (F.max("total_weight") + 1e-6),
}


def fitness(name: str) -> Column:
    """A fitness of rates by its name; an unknown name gives the mean rate."""
    return FITNESS.get(name, FITNESS["max_firing_rate"])()


def network_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(network_id, total_weight): the weights of the edges that start in each network."""
    met = edges.join(nodes.select(F.col("id").alias("src_id"), "network_id"), "src_id").groupBy("network_id").agg(F.sum("weight").alias("total_weight"))
    return nodes.select("network_id").distinct().join(met, "network_id", "left").select("network_id", F.coalesce("total_weight", F.lit(0.0)).alias("total_weight"))


#: Added before a mean is rounded: engines round a tie such as 4201.315 differently, one by its digits, another by its bits.
TIE = 1e-9


def network_stats(nodes: DataFrame, spikes: DataFrame, edges: DataFrame, t: Column | float) -> DataFrame:
    """A row for each network: counts, mean potential, spikes, synchrony and time."""
    rated = rates(nodes, spikes, t)
    n_edges = edges.join(nodes.select(F.col("id").alias("src_id"), "network_id"), "src_id").groupBy("network_id").agg(F.count("*").alias("n_synapses"))
    stats = rated.groupBy("network_id").agg(
        F.count("*").alias("n_neurons"), F.count_if("excitatory").alias("exc_count"), F.count_if(~F.col("excitatory")).alias("inh_count"), F.round(F.avg("v") + TIE, 2).alias("mean_v"),
        F.sum("n_spikes").alias("total_spikes"), F.round(F.max("rate"), 2).alias("max_rate"), F.round(synchrony(), 3).alias("synchrony"),
    )
    return stats.join(n_edges, "network_id", "left").withColumn("n_synapses", F.coalesce("n_synapses", F.lit(0)).cast("long")).withColumn("sim_time_ms", F.round(clock(t), 1))


def trace_window(samples: DataFrame, key: str, t: str, size: int = 200) -> DataFrame:
    """The last ``size`` samples of each key."""
    return samples.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(t).desc()))).filter(F.col("rn") <= size).drop("rn")
