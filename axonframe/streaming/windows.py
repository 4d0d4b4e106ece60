"""Spikes as a stream: windows with a watermark, results written by batch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's checkpoint folder; a local one only where the session names none."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not given and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(given or 'file://' + tempfile.mkdtemp(prefix='axonframe-')).rstrip('/')}/axonframe-{name}-{uuid.uuid4().hex}"


def spike_windows(spark: SparkSession, path: str, schema, every: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """(window_start, neuron_id, n_spikes) of the events (ts, user_id) under ``path``, read as a stream to its present end."""
    events = spark.readStream.schema(schema).parquet(path).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("neuron_id"))
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", every), "neuron_id").agg(F.count("*").alias("n_spikes"))
    out, state = _folder(spark, "windows"), _folder(spark, "offsets")
    rows = counts.select(F.col("window.start").alias("window_start"), "neuron_id", "n_spikes")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    query = rows.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.schema("window_start timestamp, neuron_id long, n_spikes long, batch long").parquet(out)
    return done.groupBy("window_start", "neuron_id").agg(F.max_by("n_spikes", "batch").alias("n_spikes"))
