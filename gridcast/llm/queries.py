"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, language_id, license_scan, line_dedup, neardup, packing, quality, secret_scan, topk, toxicity
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_runs(table(spark, sf_dir, "documents")).drop("node")


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.ownership(table(spark, sf_dir, "documents"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_mixtures(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_notices(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("node")


def op8_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("node")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_secret_ownership,
        op3_language_mixture,
        op4_license_scan,
        op5_best_fit_packing,
        op6_compression_quality,
        op7_decontamination,
        op8_maxscore_topk,
        op9_toxic_passages,
        op10_simhash_near_dedup,
    )
}

#: Where SQL can express the operator; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.RUNS_SQL,
    "op2_secret_ownership": secret_scan.OWNERSHIP_SQL,
    "op4_license_scan": license_scan.LICENSES_SQL,
    "op8_maxscore_topk": topk.TOP_SQL,
}
