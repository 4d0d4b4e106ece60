"""Columns and frames that a viewer draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.presets import RADII
from .ranks import rank_in
from .timeline import running


def radius(kind):
    table = F.create_map(*[F.lit(x) for pair in RADII.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(8))


def rate_bars(rated: DataFrame) -> DataFrame:
    """Adds bar: the rate in percent of the largest in its network, or of 1."""
    top = rated.groupBy("network_id").agg(F.greatest(F.max("rate"), F.lit(1.0)).alias("top"))
    return rated.join(top, "network_id").withColumn("bar", F.col("rate") / F.col("top") * 100).drop("top")


def pulses(spikes: DataFrame, edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Every spike on every edge of its neuron with the ends' coordinates, which the edges have before they meet the spikes."""
    end = lambda k, p: placed.select(F.col("id").alias(k), F.col("x").alias(p + "x"), F.col("y").alias(p + "y"))
    drawn = edges.select("src_id", "tgt_id").join(end("tgt_id", "t"), "tgt_id").join(end("src_id", "s"), "src_id")
    met = drawn.join(spikes.withColumnRenamed("neuron_id", "src_id"), "src_id")
    return met.select("src_id", "tgt_id", "t_ms", "sx", "sy", "tx", "ty")


def animate(moving: DataFrame, step: float = 0.06) -> DataFrame:
    """The frames of each pulse until it arrives: place and opacity."""
    n = int(1 / step)
    out = moving.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("p", F.col("frame") * step).filter("p < 1")
    at = lambda a, b: F.round(F.col(a) + (F.col(b) - F.col(a)) * F.col("p"), 6)
    return out.withColumn("x", at("sx", "tx")).withColumn("y", at("sy", "ty")).withColumn("opacity", F.round(1 - 0.7 * F.col("p"), 6))


def raster(spikes: DataFrame, nodes: DataFrame, height: int = 120) -> DataFrame:
    """(id, t_ms, y, color): a row of dots for each neuron, by its rank in its network."""
    ranked = rank_in(nodes, ["network_id"], "id")
    y = F.floor(F.col("rank") / F.greatest(F.col("size") - 1, F.lit(1)) * (height - 2) + 0.5).cast("long")
    return spikes.withColumnRenamed("neuron_id", "id").join(ranked, "id").select("id", "t_ms", y.alias("y"), F.when(F.col("excitatory"), "exc").otherwise("inh").alias("color"))


def merge_state(kept: DataFrame, updates: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``kept`` with the columns of the last update of each key; keys that are not there are left out."""
    last = updates.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("u"))
    return kept.join(last, key, "left").select(*[c for c in kept.columns if c not in columns], *[F.coalesce(F.col(f"u.{c}"), F.col(c)).alias(c) for c in columns])


def frames(spikes: DataFrame, width: float = 20.0) -> DataFrame:
    """(frame, n_spikes, ids): what falls into each frame of ``width`` ms."""
    return spikes.groupBy(F.floor(F.col("t_ms") / width).alias("frame")).agg(F.count("*").alias("n_spikes"), F.array_join(F.transform(F.sort_array(F.collect_list("neuron_id")), lambda x: x.cast("string")), ",").alias("ids"))


def frame_rows(nodes: DataFrame, edges: DataFrame, spikes: DataFrame) -> DataFrame:
    """(part, id, other, value, flag): a state frame as rows, so that it is no larger than a row however large the network.

    Nodes give (id, v, firing), edges (src, tgt, weight, active) and spikes (id, t).
    """
    none, off = F.lit(None).cast("long"), F.lit(None).cast("boolean")
    parts = [
        nodes.select(F.lit("neuron").alias("part"), "id", none.alias("other"), F.round("v", 2).alias("value"), F.col("firing").alias("flag")),
        edges.select(F.lit("synapse").alias("part"), F.col("src_id").alias("id"), F.col("tgt_id").alias("other"), F.round("weight", 3).alias("value"), F.col("active").alias("flag")),
        spikes.select(F.lit("spike").alias("part"), F.col("neuron_id").alias("id"), none.alias("other"), F.round("t_ms", 2).alias("value"), off.alias("flag")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def anchored_frame(t, dt: float = 0.3, every: float = 20.0):
    """The number of the frame that ``t`` falls into where a frame ends with the first step of ``dt`` that is ``every`` ms or more from its start.

    Each frame starts where the one before was sent, so a frame is a whole number of steps.
    """
    steps = -int(-round(every / dt, 9) // 1)
    return F.floor(F.floor(F.round(t / dt, 6)) / steps)


def frame_stats(nodes: DataFrame, edges: DataFrame, spikes: DataFrame, width: float = 20.0, segment: float = 1e6) -> DataFrame:
    """The statistics part of the state frames: a row for each network and each frame in which one of its neurons fires.

    (network_id, frame, t_ms, n_neurons, exc_count, inh_count, n_synapses, mean_v, firing, frame_spikes, total_spikes,
    mean_rate, synchrony) at the frame's end ``t_ms``. Running totals come from sparse frames: the spread of the rates needs
    the sum of the squared counts, which a neuron's k-th spike moves by 2k - 1. Rates are not rounded before their spread.
    """
    own = spikes.withColumnRenamed("neuron_id", "id").join(nodes.select("id", "network_id"), "id").withColumn("frame", F.floor(F.col("t_ms") / width))
    per_neuron = own.groupBy("network_id", "id", "frame").agg(F.count("*").alias("k"))
    counted = running(per_neuron.withColumn("upto", F.col("k")), ["network_id", "id"], "frame", ["upto"], segment)
    squares = F.col("upto") * F.col("upto") - (F.col("upto") - F.col("k")) * (F.col("upto") - F.col("k"))
    per_frame = counted.groupBy("network_id", "frame").agg(F.count("*").alias("firing"), F.sum("k").alias("frame_spikes"), F.sum("k").alias("total_spikes"), F.sum(squares).alias("square"))
    totals = running(per_frame, ["network_id"], "frame", ["total_spikes", "square"], segment)

    fixed = nodes.groupBy("network_id").agg(F.count("*").alias("n_neurons"), F.count_if("excitatory").alias("exc_count"), F.count_if(~F.col("excitatory")).alias("inh_count"), F.avg("v").alias("mean_v"))
    n_edges = edges.join(nodes.select(F.col("id").alias("src_id"), "network_id"), "src_id").groupBy("network_id").agg(F.count("*").alias("n_synapses"))
    met = totals.join(fixed.join(n_edges, "network_id", "left"), "network_id").withColumn("t_ms", (F.col("frame") + 1) * width)
    n, scale = F.col("n_neurons"), 1000.0 / F.greatest("t_ms", F.lit(1.0))
    rate = F.col("total_spikes") / n * scale
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("square") / n - (F.col("total_spikes") / n) * (F.col("total_spikes") / n))) * scale
    sync = F.when(n <= 1, 1.0).otherwise(1.0 - F.least(F.lit(1.0), spread / (rate + 1e-6)))
    return met.select("network_id", "frame", "t_ms", "n_neurons", "exc_count", "inh_count", F.coalesce("n_synapses", F.lit(0)).alias("n_synapses"), "mean_v", "firing", "frame_spikes", "total_spikes", rate.alias("mean_rate"), sync.alias("synchrony"))


def field_rows(df: DataFrame, part: str, id: str, other: str | None, fields: list[str]) -> DataFrame:
    """(part, id, other, field, value, text): a row for each field of each row; numbers and flags are values, strings are texts."""
    kinds = dict(df.dtypes)
    one = lambda f: F.struct(F.lit(f).alias("field"), (F.lit(None) if kinds[f] == "string" else F.col(f)).cast("double").alias("value"), (F.col(f) if kinds[f] == "string" else F.lit(None)).cast("string").alias("text"))
    each = df.select(F.lit(part).alias("part"), F.col(id).cast("long").alias("id"), (F.col(other) if other else F.lit(None)).cast("long").alias("other"), F.explode(F.array(*map(one, fields))).alias("f"))
    return each.select("part", "id", "other", "f.*")


def active_edges(wires: DataFrame, spikes: DataFrame, step) -> DataFrame:
    """``wires`` with active: whether a spike arrives over the edge in the step of 1 ms that ends at ``step``.

    Only spikes within the longest delay before the step can, so no others meet the edges.
    """
    longest = wires.select(F.max("delay_ms")).scalar()
    recent = spikes.filter(F.col("t_ms") >= step - longest - 2).select(F.col("neuron_id").alias("src_id"), "t_ms").distinct()
    at = F.greatest(F.floor("t_ms") + 1, F.ceil(F.col("t_ms") + F.col("delay_ms")))
    hit = wires.select("src_id", "tgt_id", "delay_ms").join(recent, "src_id").filter(at == step).select("src_id", "tgt_id").distinct()
    return wires.join(hit.withColumn("active", F.lit(True)), ["src_id", "tgt_id"], "left").withColumn("active", F.coalesce("active", F.lit(False)))


def ordered_history(nodes: DataFrame, samples: DataFrame, slots: int) -> DataFrame:
    """(id, slot, v): each node's last ``slots`` samples (id, step, v), oldest first; slots not yet filled, the first ones, have its v_rest.

    The last samples are found before anything is shuffled: the limit is taken within each partition first.
    """
    last = samples.withColumn("back", F.row_number().over(Window.partitionBy("id").orderBy(F.col("step").desc()))).filter(F.col("back") <= slots)
    grid = nodes.select("id", "v_rest", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    met = grid.join(last.select("id", (slots - F.col("back")).alias("slot"), "v"), ["id", "slot"], "left")
    return met.select("id", "slot", F.coalesce("v", "v_rest").alias("v"))


def snapped(value, least: float, most: float, step: float):
    """A slider's value: held within its bounds and on the nearest of its steps, the upper one of two."""
    held = F.greatest(F.lit(least), F.least(F.lit(most), value))
    return F.least(F.lit(most), least + F.floor(F.round((held - least) / step, 6) + 0.5) * step)
