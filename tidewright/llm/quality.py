"""Operator 9: importance resampling for quality.

Two bag-of-n-gram models over hashed words and word pairs, one of the target text (documents labelled good) and one of all raw text; a document's
log importance weight is the sum of the log ratios of its n-grams. Gumbel noise, a hash of the id, is added to the weight and the k
largest are taken, which samples without replacement in proportion to the weights. k is a share of the rows, by default the share
of good ones among labelled rows. Both models count over all documents.

Null and empty texts weigh 0 (log). Null labels and ids count as not labelled; repeated rows are weighed alike. Equal keys come from rows that
share an id and a text: where they straddle the cut, as many of them as are missing to k are taken, by row number, which is found like the
cut itself without gathering them. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .selection import kth_largest

BUCKETS = 1 << 15
FILTER_WORDS = 1 << 18
WORD = re.compile(r"\w+|[^\w\s]+")
_words: dict[str, int] = {}


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all words and word pairs of the whole text."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int64)
    if len(_words) > 400_000:
        _words.clear()
    get, ids = _words.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _words[w] = xxhash.xxh3_64_intdigest(w) >> 1
        ids.append(h)
    one = np.array(ids, np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    return (np.concatenate((one, two >> np.uint64(7))) % np.uint64(buckets)).astype(np.int64)


def log_ratio(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Smoothed log(target / raw) of each bucket. docs: (doc_id, text); target: distinct ids. The result has `buckets` numbers whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                texts = whole.slice(k, 500).column(0).to_pylist()
                sums += np.bincount(np.concatenate([ngram_buckets(t, buckets) for t in texts]), minlength=buckets)
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(sums)], ["b", "n"])

    def counted(texts: DataFrame) -> dict[int, int]:
        rows = texts.select("text").mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
        return {r.b: r.n for r in rows}

    raw, good = np.ones(buckets), np.ones(buckets)
    for sums, texts in ((raw, docs), (good, chosen(docs, target))):
        for b, n in counted(texts).items():
            sums[b] += n
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def chosen(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The documents whose id is in target. All others but a few go before the shuffle, by FILTER_WORDS * 64 bits of id hashes: at most
    FILTER_WORDS rows are sent to the tasks, however many ids there are. The join on the id that follows is exact."""
    hashed = F.xxhash64("doc_id")
    word, bit = F.pmod(hashed, F.lit(FILTER_WORDS).cast("long")), F.shiftright(hashed, 58).bitwiseAND(F.lit(63).cast("long"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
    words = target.select(word.alias("__word"), one.alias("__bits")).groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))
    marked = docs.select("doc_id", "text", word.alias("__w"), one.alias("__b"))
    likely = marked.join(F.broadcast(words), (F.col("__w") == F.col("__word")) & (F.col("__b").bitwiseAND(F.col("__bits")) != 0), "left_semi")
    return likely.select("doc_id", "text").hint("merge").join(target, "doc_id", "left_semi")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float | None = None, seed: int = 17, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, selected) of every row; exactly round(keep * rows) rows are selected."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good, all_ = marks.agg(F.sum((F.col("quality") > 0).cast("long")), F.count("*")).first()
    share = keep if keep is not None else (good or 0) / all_ if all_ else 1.0
    ratio = log_ratio(rows, marks.where("quality > 0").select("doc_id"), buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights, noise = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                weights.append(float(ratio[ngram_buckets(t, buckets)].sum()))
                u = (xxhash.xxh3_64_intdigest(f"{seed}/{d}") + 0.5) / 2.0**64
                noise.append(weights[-1] - math.log(-math.log(min(max(u, 1e-18), 1 - 1e-16))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weights, pa.float64()), pa.array(noise, pa.float64())], ["doc_id", "log_weight", "gumbel_key"])

    drawn = rows.mapInArrow(weigh, "doc_id long, log_weight double, gumbel_key double")
    scored = materialise(drawn.withColumn("__tie", F.monotonically_increasing_id()), "weights")
    n = scored.count()
    k = round(share * n)
    cut = kth_largest(scored, "gumbel_key", k)
    taken = F.col("gumbel_key") >= cut
    tied = scored.where(F.col("gumbel_key") == cut).select((-F.col("__tie")).cast("double").alias("place"))
    above, at_cut = (scored.where(F.col("gumbel_key") > cut).count(), tied.count()) if 0 < k < n else (0, 0)
    if at_cut > k - above:  # row numbers differ, so their k-th is exact
        last = kth_largest(tied, "place", k - above)
        taken = (F.col("gumbel_key") > cut) | (F.col("gumbel_key") == cut) & (-F.col("__tie") >= F.lit(int(last)).cast("long"))
    return scored.select("doc_id", "log_weight", "gumbel_key", taken.alias("selected"))
