"""Operator 4: temperature mixing of sources, with DataFrame functions only.

Each source's share of all tokens is raised to an exponent between 0 (uniform) and 1 (as it is) and normalised. The exponent is found by bisection,
BRANCH intervals a pass: the largest for which the entropy of the weights reaches `target_entropy`, or for which no source is repeated more than
`repeat_limit` times. The weights times a token budget give each source's tokens; without a budget it is the least one that uses every
document once. A source is dealt into BLOCKS blocks by a hash of the id; each pass over it takes the blocks in an order of its own, whole passes
first, and the last pass takes blocks until the source's budget ends, the last block by a cut in the hash order of its documents.

So the decision on a document depends on its source, block and hash alone: a table of at most sources * passes * BLOCKS rows, which is sent to
the tasks when it has MAX_PLAN rows at most and is joined by a shuffle on (source, block) otherwise; a hot source is spread over its blocks.

A null source is a source of its own, a null or empty text has no tokens (it goes with its block in whole passes), a null id hashes like an id;
rows that repeat are taken alike. Other columns stay. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCKS = 1024
BRANCH = 64
MAX_PLAN = 100_000
NO_SOURCE = "\x00"


def token_count(text_col: str):
    """Words between ASCII white space."""
    text = F.trim(F.translate(F.coalesce(F.col(text_col), F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " +"))).cast("long")


def _keys(id_col: str, source_col: str, seed: int) -> tuple:
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    return source, F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(BLOCKS).cast("long")).cast("int")


def find_exponent(sources: DataFrame, total: int, target_entropy: float | None, repeat_limit: float | None, budget: float | None, passes: int = 4) -> float:
    """Bisection with BRANCH intervals a pass; a pass is one aggregation over the sources that returns BRANCH + 1 rows."""
    low, high = 0.0, 1.0
    logs = sources.select((F.log("tokens") - math.log(total)).alias("lp"))
    for _ in range(passes):
        step = (high - low) / BRANCH
        grid = logs.select("lp", F.explode(F.sequence(F.lit(0), F.lit(BRANCH))).alias("k")).withColumn("a", F.lit(low) + F.col("k") * step)
        rows = grid.groupBy("k", "a").agg(F.sum(F.exp(F.col("a") * F.col("lp"))).alias("z"), F.sum(F.exp(F.col("a") * F.col("lp")) * F.col("lp")).alias("s"), F.min("lp").alias("least"), F.max("lp").alias("most")).collect()

        def fits(r) -> bool:
            if target_entropy is not None and math.log(r.z) - r.a * r.s / r.z < target_entropy:
                return False
            if repeat_limit is not None:  # the smallest source is repeated most
                repeats = math.exp((r.a - 1) * (r.least - r.most)) if budget is None else budget * math.exp((r.a - 1) * r.least) / (r.z * total)
                if repeats > repeat_limit * (1 + 1e-12):
                    return False
            return True

        # entropy falls with the exponent and so do repetitions: the first bounds it from above, the second from below
        good = sorted(r.k for r in rows if fits(r))
        if not good:
            return high if repeat_limit is not None else low
        edge = good[-1] if target_entropy is not None else good[0]
        low, high = (low + edge * step, min(high, low + (edge + 1) * step)) if target_entropy is not None else (max(0.0, low + (edge - 1) * step), low + edge * step)
    return low if target_entropy is not None else high


def plan(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target_entropy: float | None = None, repeat_limit: float | None = 2.0, budget: int | None = None, seed: int = 23) -> DataFrame:
    """(source, block, epoch, place, cut, weight): what is taken of each source's block in each pass; cut: up to which hash, null for all."""
    source, block = _keys(id_col, source_col, seed)
    blocks = materialise(df.select(source.alias("source"), block.alias("block"), token_count(text_col).alias("tokens")).groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    sources = materialise(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    some = sources.where("tokens > 0")
    total, most = some.agg(F.sum("tokens"), F.max("tokens")).first()
    if not total:
        return blocks.select("source", "block", F.lit(0).alias("epoch"), F.lit(0.0).alias("place"), F.lit(None).cast("long").alias("cut"), F.lit(0.0).alias("weight"))
    a = find_exponent(some, total, target_entropy, repeat_limit, float(budget) if budget else None)
    power = F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(float(total))))
    z = some.agg(F.sum(power)).first()[0]
    tokens = float(budget) if budget else most / (math.exp(a * math.log(most / total)) / z)
    epochs = F.when(F.col("tokens") > 0, F.round(F.col("weight") * F.lit(tokens) / F.col("tokens"), 9)).otherwise(F.lit(1.0))
    shares = sources.withColumn("weight", F.when(F.col("tokens") > 0, power / F.lit(z)).otherwise(F.lit(0.0))).withColumn("epochs", epochs)
    shares = shares.select("source", "weight", "epochs", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs").cast("int") - 1, F.lit(0)))).alias("epoch"), (F.col("tokens") * F.col("epochs")).alias("goal"), F.col("tokens").alias("all_tokens"))
    spread = blocks.join(shares, "source")
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), F.col("epoch"), F.col("block")), "block")
    before = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spread = spread.withColumn("start", F.coalesce(before, F.lit(0)) + F.col("epoch") * F.col("all_tokens"))
    spread = materialise(spread.where((F.col("start") < F.col("goal")) | (F.col("epoch") + 1 <= F.col("epochs"))).withColumn("room", F.when(F.col("epoch") + 1 <= F.col("epochs"), None).otherwise(F.col("goal") - F.col("start"))), "mix-spread")
    split = spread.where("room < tokens").select("source", "block", "epoch", "room")
    inside = df.select(source.alias("source"), block.alias("block"), F.col(id_col).alias("__id"), token_count(text_col).alias("n")).join(split, ["source", "block"])
    inside = inside.withColumn("h", F.xxhash64(F.lit(seed), F.col("epoch"), F.lit("doc"), F.col("__id")))
    run = Window.partitionBy("source", "epoch").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = inside.withColumn("upto", F.sum("n").over(run)).where("upto <= room").groupBy("source", "epoch", "block").agg(F.max("h").alias("cut"))
    marked = spread.join(cuts, ["source", "block", "epoch"], "left")
    least = F.lit(-(2**63)).cast("long")
    return materialise(marked.select("source", "block", "epoch", (F.col("start") / F.greatest(F.col("goal"), F.lit(1.0))).alias("place"), F.when(F.col("room") < F.col("tokens"), F.coalesce("cut", least)).alias("cut"), "weight"), "mix-plan")


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 23, **options) -> DataFrame:
    """df's rows, each as often as its source's passes take it, with __epoch, __place (0 to 1: where in the mixture its block lies) and __weight."""
    todo = plan(df, id_col, source_col, text_col, seed=seed, **options).select(F.col("source").alias("__source"), F.col("block").alias("__block"), F.col("epoch").alias("__epoch"), F.col("place").alias("__place"), F.col("cut").alias("__cut"), F.col("weight").alias("__weight"))
    source, block = _keys(id_col, source_col, seed)
    small = todo.count() <= MAX_PLAN
    out = df.withColumn("__source", source).withColumn("__block", block).join(F.broadcast(todo) if small else todo, ["__source", "__block"])
    h = F.xxhash64(F.lit(seed), F.col("__epoch"), F.lit("doc"), F.col(id_col))
    return out.where(F.col("__cut").isNull() | (h <= F.col("__cut"))).drop("__source", "__block", "__cut")


def mixture(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, place, weight): a row for each time that the mixture takes a document."""
    return mix(df, id_col, source_col, text_col, **options).select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), token_count(text_col).alias("n_tokens"), F.col("__epoch").alias("epoch"), F.col("__place").alias("place"), F.col("__weight").alias("weight"))
