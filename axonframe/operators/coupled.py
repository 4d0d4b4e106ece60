"""A coupled network in steps: neurons are rows, a step is a plan, delays are the step at which a kick arrives.

Work is parallel over neurons and edges, so the size of a network is no bound; the number of steps is
one, since each step is a job. Long runs of small uncoupled cells belong in ``dynamics``.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder; a local one only where the session names none."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = context.getConf().get("spark.checkpoint.dir")
        if not given and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(given or "file://" + tempfile.mkdtemp(prefix="axonframe-"))
    return df.checkpoint()


def simulate(spark: SparkSession, cells: DataFrame, wires: DataFrame, steps: int, dt: float = 1.0) -> DataFrame:
    """(id, v, spikes) after so many steps of leaky cells (id, v, v_rest, v_reset, v_threshold, tau_m, tau_ref, r_m, current) over wires (src_id, tgt_id, delay_ms, strength).

    A spike at step k reaches the target at step k + max(1, ceil(delay / dt)) as an added current.
    """
    wires = cut(spark, wires.select("src_id", "tgt_id", F.greatest(F.lit(1), F.ceil(F.col("delay_ms") / dt)).cast("int").alias("wait"), "strength"))
    state = cut(spark, cells.withColumn("ref", F.lit(0.0)).withColumn("spikes", F.lit(0).cast("long")))
    pending = None
    for k in range(1, steps + 1):
        now = state.withColumn("kick", F.lit(0.0)) if pending is None else state.join(pending.filter(F.col("at") == k).groupBy(F.col("tgt_id").alias("id")).agg(F.sum("strength").alias("kick")), "id", "left")
        moved = F.col("v") + (-(F.col("v") - F.col("v_rest")) + F.col("r_m") * (F.col("current") + F.coalesce("kick", F.lit(0.0)))) / F.col("tau_m") * dt
        resting = F.col("ref") > 0
        now = now.withColumn("moved", moved).withColumn("fired", ~resting & (F.col("moved") >= F.col("v_threshold")))
        state = cut(spark, now.withColumns({
            "v": F.when(resting | F.col("fired"), F.col("v_reset")).otherwise(F.col("moved")),
            "ref": F.when(resting, F.col("ref") - dt).when(F.col("fired"), F.col("tau_ref")).otherwise(F.col("ref")),
            "spikes": F.col("spikes") + F.col("fired").cast("long"),
        }).drop("moved", "kick"))
        sent = state.filter("fired").select(F.col("id").alias("src_id")).join(wires, "src_id").select("tgt_id", (F.lit(k) + F.col("wait")).alias("at"), "strength")
        sent = sent.groupBy("tgt_id", "at").agg(F.sum("strength").alias("strength"))
        pending = cut(spark, sent if pending is None else pending.filter(F.col("at") > k).unionByName(sent))
        state = state.drop("fired")
    return state.select("id", "v", "spikes")
