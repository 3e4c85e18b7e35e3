"""The training-data queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, gbdt_quality, jaccard_join, lang_cnn, mixing, pii, quality_rules, sharding, toxicity, warc
from .common import pick, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_cnn.identify(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_degrees(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gbdt_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(pick(table(spark, sf_dir, "documents"), doc_id="long", source="string"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole method, near matches included; of its columns those of the contract and the SQL (op10_near_matches has all)."""
    return op10_near_matches(spark, sf_dir).drop("n_near_items", "near_items_sha256")


def op10_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_language, op3_mix_sources, op4_toxicity, op5_warc, op6_pii, op7_jaccard_join, op7_links, op8_quality_classifier, op9_sharding, op10_decontamination, op10_near_matches)}

ORACLES: dict[str, Callable[[], str]] = {"op3_mix_sources": mixing.oracle_sql, "op5_warc": warc.oracle_sql, "op7_jaccard_join": jaccard_join.oracle_sql, "op7_links": jaccard_join.links_sql, "op9_sharding": sharding.oracle_sql, "op10_decontamination": decontam.oracle_sql, "op10_near_matches": decontam.near_sql}
