"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytecnn, chat, decontam, divergence, kmeans, lattice, linedup, minhash, mixing, pii, quality, substring, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _docs(spark, sf_dir)).drop("text_key")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(_docs(spark, sf_dir)))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(spark, _docs(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(spark, _docs(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _docs(spark, sf_dir), mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.classify(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spark, _docs(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.repeated_lines(spark, _docs(spark, sf_dir)).drop("d1")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, _docs(spark, sf_dir))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.read_back(chat.format_conversations(turns.unionByName(chat.hostile_conversation(spark)))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_minhash, op2_quality_rules, op3_lattice, op4_substring_dedup, op5_mixing, op6_byte_cnn, op7_decontaminate, op8_pii, op9_line_dedup, op10_warc, op11_kmeans, op12_source_divergence, op13_chat_format)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": minhash.OP1_SQL, "op2_quality_rules": quality.OP2_SQL, "op10_warc": warc.OP10_SQL, "op11_kmeans": kmeans.OP11_SQL, "op12_source_divergence": divergence.OP12_SQL, "op13_chat_format": chat.OP13_SQL}
