"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import byte_dedup, decontaminate, html_extract, mixing, quality_classifier, quality_rules, sharding, simhash, url_filter, word_dedup
from terraloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_fixed_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents")).drop("host_rate")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draws(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_simhash, op2_url_filter, op3_sharding, op4_fixed_block_dedup, op5_decontamination, op6_quality_classifier, op7_quality_rules, op8_mixing, op9_suffix_array_dedup, op10_html_extraction, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": sharding.ORACLE, "op4_fixed_block_dedup": word_dedup.ORACLE, "op7_quality_rules": quality_rules.ORACLE, "op8_mixing": mixing.ORACLE}
