"""Folders of SQL files as script corpora (script_id: the file's address, sql: its whole text), at rest and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _named(files: DataFrame) -> DataFrame:
    return files.select(F.col("_metadata.file_path").alias("script_id"), F.col("value").alias("sql"))


def read_scripts(spark: SparkSession, folder: str, pattern: str = "*.sql") -> DataFrame:
    """One row per file below the folder; an empty file is an empty script."""
    return _named(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True))


def stream_scripts(spark: SparkSession, folder: str, pattern: str = "*.sql", files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream: files that appear below the folder, at most files_per_batch of them in a batch."""
    files = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return _named(files.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True))
