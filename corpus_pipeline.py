"""The corpus pipeline: toxic documents go, then exact copies, then near copies; sources are mixed; documents are packed.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; all but the last return the columns of documents. The mixing
stage takes every document at least once and small sources up to twice, so it drops none and repeats some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import exact_dedup, mixing, packing, simhash, toxicity
from tidewright.llm.common import read_table, remove, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, repeat_limit=2.0).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("temperature mixing", mix_sources),
    ("packing", pack_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is written in the shared folder, and removed when the next one has been."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path, schema = scratch(spark, f"stage-{k}"), docs.schema
            docs.write.parquet(path)
            docs = spark.read.schema(schema).parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
