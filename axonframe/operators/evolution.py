"""Genetic search over neuron parameters, and structural change of the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.presets import GENES
from ..functions.rng import gauss, uniform
from .ranks import rank_down


def low(i: Column) -> Column:
    """The lower bound of gene ``i``, from 0."""
    return F.element_at(F.array(*[F.lit(lo) for _, lo, _ in GENES]), i + 1)


def high(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(hi) for _, _, hi in GENES]), i + 1)


def encode() -> Column:
    return F.array(*[F.col(g) for g, _, _ in GENES])


def clamp(genome: Column) -> Column:
    return F.transform(genome, lambda x, i: F.greatest(low(i), F.least(high(i), x)))


def mutate(genome: Column, key: Column, rate: float = 0.15, scale: float = 0.10, seed: str = "mut") -> Column:
    """Each gene moves by chance ``rate``, by a normal draw of ``scale`` of its range; only genes that move are clamped."""

    def gene(x, i):
        lo, hi = low(i), high(i)
        return F.when(uniform(seed + "u", key, i) < rate, F.greatest(lo, F.least(hi, x + gauss(seed, key, i) * (hi - lo) * scale))).otherwise(x)

    return F.transform(genome, gene)


def crossover(a: Column, b: Column, key: Column, seed: str = "cross") -> Column:
    return F.transform(a, lambda x, i: F.when(uniform(seed, key, i) < 0.5, x).otherwise(F.element_at(b, i + 1)))


def scores(rated: DataFrame, network_fitness: DataFrame) -> DataFrame:
    """``rated`` (id, network_id, rate) with score = 0.6 * fitness of the network + 0.4 * rate."""
    return rated.join(network_fitness, "network_id").withColumn("score", 0.6 * F.col("fitness") + 0.4 * F.col("rate"))


def elites(scored: DataFrame, share: float = 0.2) -> DataFrame:
    """The best of each network by (score, id), with their rank from 0: a share of them, one at least."""
    ranked = rank_down(scored, ["network_id"], "score", "id").withColumn("n_elite", F.greatest(F.lit(1), F.floor(F.col("size") * share))).drop("size")
    return ranked.filter(F.col("rank") < F.col("n_elite"))


def parents(children: DataFrame, best: DataFrame, seed: str = "par") -> DataFrame:
    """(id, parent_a, parent_b): elites drawn with replacement; parent_b is null for children without crossover."""
    size = best.groupBy("network_id").agg(F.count("*").alias("k"))
    drawn = children.join(size, "network_id").select("id", "network_id", F.floor(uniform(seed + "a", "id") * F.col("k")).alias("ra"), F.when((F.col("k") > 1) & (uniform(seed + "x", "id") < 0.5), F.floor(uniform(seed + "b", "id") * F.col("k"))).alias("rb"))
    pick = lambda r, name: best.select("network_id", F.col("rank").alias(r), F.col("id").alias(name))
    return drawn.join(pick("ra", "parent_a"), ["network_id", "ra"]).join(pick("rb", "parent_b"), ["network_id", "rb"], "left").select("id", "parent_a", "parent_b")


def generation(genomes: DataFrame, scored: DataFrame, share: float = 0.2, seed: str = "g0") -> DataFrame:
    """(id, network_id, genome) of the next generation: elites stay, the others descend from them."""
    best = elites(scored, share).select("network_id", "id", "rank")
    kept = genomes.join(best.select("id"), "id", "left_semi")
    rest = genomes.join(best.select("id"), "id", "left_anti")
    drawn = parents(rest.select("id", "network_id"), best, seed)
    pick = lambda name: genomes.select(F.col("id").alias(name), F.col("genome").alias("g_" + name))
    met = drawn.join(pick("parent_a"), "parent_a").join(pick("parent_b"), "parent_b", "left").join(rest.select("id", "network_id"), "id")
    child = F.when(F.col("g_parent_b").isNull(), F.col("g_parent_a")).otherwise(crossover(F.col("g_parent_a"), F.col("g_parent_b"), F.col("id"), seed + "c"))
    return kept.select("id", "network_id", "genome").unionByName(met.select("id", "network_id", clamp(mutate(child, F.col("id"), seed=seed + "m")).alias("genome")))


def prune_edges(edges: DataFrame, least: float = 0.05) -> DataFrame:
    return edges.filter(F.col("weight") >= least)


def summary(scored: DataFrame, share: float = 0.2) -> DataFrame:
    return scored.groupBy("network_id").agg(F.round(F.max("score"), 4).alias("best_fitness"), F.round(F.avg("score"), 4).alias("mean_fitness"), F.greatest(F.lit(1), F.floor(F.count("*") * share)).cast("long").alias("elite_count"))


def grow(nodes: DataFrame, mean_rates: DataFrame, least_rate: float = 0.05, most: int = 100, links: int = 3, seed: str = "grow") -> DataFrame:
    """(network_id, new_id, src_id, weight, distance): edges into one new neuron of each network that is quiet and small."""
    quiet = mean_rates.filter((F.col("mean_rate") < least_rate) & (F.col("n") < most)).select("network_id", "next_id")
    near = nodes.join(quiet, "network_id").withColumn("draw", uniform(seed, "next_id", "id"))
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("network_id").orderBy("draw", "id"))).filter(F.col("rn") <= links)
    return near.select("network_id", F.col("next_id").alias("new_id"), F.col("id").alias("src_id"), (0.5 + 1.5 * uniform(seed + "w", "next_id", "id")).alias("weight"), (0.5 + 1.5 * uniform(seed + "d", "next_id", "id")).alias("distance"))


def silent(counted: DataFrame, t: float, after: float = 2000.0) -> DataFrame:
    """The ids of the nodes that have not fired at all (n_spikes 0), once the clock has passed ``after``."""
    return counted.filter((F.col("n_spikes") == 0) & F.lit(t > after)).select("id")


def structural_step(counted: DataFrame, edges: DataFrame, t: float, least_weight: float = 0.05, after: float = 2000.0, least_rate: float = 0.05, most: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and a report of each network after weak edges and silent nodes go and quiet networks grow.

    ``counted`` has (id, network_id, n_spikes). Silent nodes take their edges along; a network whose
    remaining mean rate is low gets one new node, with edges of type ampa from a few others.
    """
    kept = prune_edges(edges, least_weight)
    gone = silent(counted, t, after)
    left = counted.join(gone, "id", "left_anti")
    for end in ("src_id", "tgt_id"):
        kept = kept.join(gone.withColumnRenamed("id", end), end, "left_anti")
    last = counted.select(F.max("id")).scalar()
    per = left.groupBy("network_id").agg((F.sum("n_spikes") / F.lit(max(t, 1.0)) * 1000.0 / F.count("*")).alias("mean_rate"), F.count("*").alias("n"))
    # New ids follow the largest one, in the order of the networks.
    quiet = per.filter((F.col("mean_rate") < least_rate) & (F.col("n") < most))
    number = F.count("*").alias("number")
    place = quiet.alias("q").join(quiet.select(F.col("network_id").alias("before")), F.col("before") <= F.col("network_id")).groupBy("network_id").agg(number)
    means = per.join(place, "network_id").select("network_id", "mean_rate", "n", (last + F.col("number")).alias("next_id"))
    grown = grow(left.select("id", "network_id"), means, least_rate, most)
    fresh = means.select(F.col("next_id").alias("id"), "network_id", F.lit(0).cast("long").alias("n_spikes"))
    new_edges = grown.select("src_id", F.col("new_id").alias("tgt_id"), "weight", "distance", F.lit("ampa").alias("syn_type"))
    home = counted.select(F.col("id").alias("src_id"), "network_id")
    weak = edges.filter(F.col("weight") < least_weight).join(home, "src_id").groupBy("network_id").agg(F.count("*").alias("pruned_synapses"))
    mute = counted.join(gone, "id", "left_semi").groupBy("network_id").agg(F.count("*").alias("pruned_neurons"))
    added = means.select("network_id", F.lit(1).cast("long").alias("added_neurons"))
    report = counted.select("network_id").distinct()
    for part in (weak, mute, added):
        report = report.join(part, "network_id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pruned_synapses", "pruned_neurons", "added_neurons")]
    return left.select("id", "network_id", "n_spikes").unionByName(fresh), kept.select("src_id", "tgt_id", "weight", "distance", "syn_type").unionByName(new_edges), report.select("network_id", *counts)
