"""Operator 2: exact duplicates with a heavy-hitter split.

Misra-Gries summaries of the digests, one a task, find every digest that may hold more than a 1/COUNTERS share of all rows. Their rows are
counted, so the winners that are broadcast are verified and at most 2 * COUNTERS; copies of these lose on the map side.
The other digests, each with a bounded share of the rows, go through one ordinary shuffle of narrow rows.

Null text counts as empty; texts equal after removing the six ASCII white-space characters form a group. The longest original stays, then the
smallest id; a null id comes after all others; of rows that also share the id exactly one is kept. Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lasting, materialise, passing

COUNTERS = 1024
SPACES = " \t\n\x0b\x0c\r"


def merge_counters(counters: dict[bytes, int], more: dict[bytes, int], k: int) -> None:
    """Adds counts and, above k counters, takes the (k+1)-th largest count from all: no digest loses more than rows / (k + 1)."""
    for d, n in more.items():
        counters[d] = counters.get(d, 0) + n
    if len(counters) > k:
        off = sorted(counters.values(), reverse=True)[k]
        for d in [d for d, n in counters.items() if n <= off]:
            del counters[d]
        for d in counters:
            counters[d] -= off


def frequent_digests(base: DataFrame, rows: int, k: int = COUNTERS) -> DataFrame:
    """At most 2k digests, with all among them that hold at least 2 rows / k of the rows (and two rows)."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[bytes, int] = {}
        for b in batches:
            found = pc.value_counts(b.column(0))
            merge_counters(counters, dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist())), k)
        if counters:
            yield pa.RecordBatch.from_pydict({"digest": pa.array(list(counters), pa.binary()), "n": pa.array(list(counters.values()), pa.int64())})

    share = rows / (k + 1)
    return base.select("digest").mapInArrow(summary, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") + share >= 2 * rows / k).where("n >= 1").select("digest")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, digest): code points of the original and the digest of the text without white space."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("size"), F.unhex(F.sha2(F.translate(text, SPACES, ""), 256)).alias("digest"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, dropped ones too."""
    base = materialise(digests(df, id_col, text_col), "digests")
    rows = base.count()
    least = max(2, math.ceil(2 * rows / counters))
    best = F.max(F.struct("size", F.bitwise_not("doc_id").alias("back")))
    heavy = base.join(F.broadcast(frequent_digests(base, rows, counters)), "digest", "left_semi").groupBy("digest").agg(F.count("*").alias("copies"), best.alias("best")).where(F.col("copies") >= least)
    heavy = materialise(heavy.select("digest", "copies", F.col("best.size").alias("top_size"), F.bitwise_not("best.back").alias("top_id")), "heavy")
    marked = base.join(F.broadcast(heavy), "digest", "left")
    wins = F.col("size").eqNullSafe(F.col("top_size")) & F.col("doc_id").eqNullSafe(F.col("top_id"))
    loses = F.col("copies").isNotNull() & ~wins
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    lost = marked.where(loses).select("doc_id", F.col("top_id").alias("keep_id"), F.col("copies").alias("group_size"), F.lit(False).alias("kept"), sha)
    group = Window.partitionBy("digest")
    order = group.orderBy(F.col("size").desc(), F.col("doc_id").asc_nulls_last())
    rest = marked.where(~loses).select("doc_id", F.first("doc_id").over(order).alias("keep_id"), F.coalesce("copies", F.count("*").over(group)).alias("group_size"), (F.row_number().over(order) == 1).alias("kept"), sha)
    return lost.unionByName(rest)


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with their columns."""
    with passing(df.sparkSession):
        kept = exact_dedup(df, id_col, text_col).where("kept").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest"))
        kept = lasting(kept, "kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = df.withColumn("__digest", F.unhex(F.sha2(F.translate(text, SPACES, ""), 256)))
    out = marked.join(kept, marked["__digest"].eqNullSafe(kept["__digest"]) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left_semi")
    if not materialise(out.groupBy(id_col, "__digest").count().where("count > 1"), "repeats").isEmpty():  # rows that share id and text
        out = out.dropDuplicates([id_col, "__digest"])
    return out.drop("__digest")
