"""Shared scratch tables: lineage is cut by Parquet written under ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of this machine only where the session names none and runs on it alone (tests)."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="axonframe-"))
        given = context.getCheckpointDir()
    return given.rstrip("/")


class Scratch:
    """Parquet tables of one query, each under a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/axonframe/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the table read back, which no lost executor can take away."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        # The plan that was cut may go, and with it its shuffle files, which Spark removes when its objects are collected.
        self.spark._jvm.System.gc()
        out._axonframe_path = path
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        """Deletes scratch tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._axonframe_path)
            path.getFileSystem(conf).delete(path, True)
