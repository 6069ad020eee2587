"""The queries of the training-data operators, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, mixing, packing, quality, secrets, simhash, spotsigs, suffix_dedup, token_planes, toxicity
from .common import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents"), repeat_limit=2.0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.token_files(read_table(spark, sf_dir, "documents"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.spotsigs_edits(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_secret_scan, op2_exact_dedup, op3_packing, op4_temperature_mixing, op5_toxicity, op6_simhash, op7_suffix_dedup, op8_token_planes, op9_importance_resampling, op10_spotsigs)
    return {f.__name__: f for f in found}


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents
)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY s) AS group_size, row_number() OVER g = 1 AS kept, s AS text_sha256
FROM t WINDOW g AS (PARTITION BY s ORDER BY n DESC, doc_id ASC NULLS LAST)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL}
