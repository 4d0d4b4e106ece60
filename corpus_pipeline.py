"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Columns other than
doc_id and text are passed on with their values, nulls too; an empty table goes through all stages;
texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from axonframe.llm import decontam, linedup, minhash, mixing, quality
from axonframe.llm.scratch import Scratch


#: Token shares of the domains that are left after the quality rules: the toxic share, a tenth of the labels, is halved.
TARGETS = {"clean": 0.95, "toxic": 0.05}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go: null, empty and very short texts among them. Rows are judged one by one, repeated ones alike."""
    return quality.keep_clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, by (doc_id, line), go, and documents that have no word left; rows with a null doc_id stay as they are, and rows repeated whole are rewritten alike."""
    return linedup.drop_repeated_lines(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id; of rows repeated whole one stays, and null doc_ids stay."""
    return minhash.one_of_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of such a doc_id; null doc_ids stay. An empty benchmark lets all through."""
    return decontam.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that have a positive rate, with their rates; null doc_ids and repeated rows are rated like any other, and without labels all have rate 1."""
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")).filter(F.col("domain").isin(list(TARGETS)))
    return mixing.mix(spark, docs, labels, TARGETS).filter("rate > 0")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing_rates)]

#: Near-set joins on rewritten texts and an iterative fit: no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
