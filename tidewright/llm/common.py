"""Shared pieces of the training-data operators: scratch tables, remote files, graph components.

Every operator first projects the id and text columns it needs under names of its own, so further columns of the input,
whatever they are called, neither clash nor travel through shuffles.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where that is unset and the session runs on this machine alone (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = tempfile.mkdtemp(prefix="tidewright-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tidewright/{name}-{uuid.uuid4().hex[:12]}"


_passing: list[list[str]] = []


def _written(df: DataFrame, name: str, scopes: list[list[str]]) -> DataFrame:
    path = scratch(df.sparkSession, name)
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: the lineage ends there, and any executor may be lost."""
    return _written(df, name, _passing)


def lasting(df: DataFrame, name: str) -> DataFrame:
    """materialise, for what the result of a `passing` block is read from: it outlasts the innermost block."""
    return _written(df, name, _passing[:-1])


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark: SparkSession):
    """What is materialised inside is removed at the end, so it must not be read afterwards."""
    mine: list[str] = []
    _passing.append(mine)
    try:
        yield
    finally:
        _passing.pop()
        for path in mine:
            remove(spark, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """pyarrow's file system and the path in it, for file:, hdfs:, s3: and gs: addresses and for plain paths."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def connected_components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, comp) for every node of the undirected edges, comp being the smallest node that it reaches.

    Alternating large-star and small-star rounds; each is two aggregations, pre-aggregated on the map side, and two joins on the node. The
    aggregates are written before they are joined, so that the join deals both sides anew and AQE can split a node with very many edges.
    Rounds end when the edge set stands still.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, seen = materialise(e, "cc"), None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        e = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    reached = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
    roots = e.select(F.col("v").alias("node")).distinct().join(reached, "node", "left_anti")
    return reached.unionByName(roots.select("node", F.col("node").alias("comp")))
