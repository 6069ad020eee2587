"""Operator 3: lexical retrieval packing.

Documents are dealt to shards by a lexical key, so that texts with the same rare-ish ids meet, and an id breaks ties, so a hot key is
spread like any other. Each shard of about SHARD_TOKENS ids gets its own inverted index over the ids of its documents; the weights of BM25 come from all documents:
document frequencies, number and mean length are counted once, in an array over the vocabulary. A seed is still answered by its own shard only.
A seed document opens a window of `window` ids; its index returns the unused documents most like it, which fill the window
greedily; the document that reaches the window's end is cut there and its rest becomes the next seed. Only the last window of a shard
is not full, so padding is under `window` ids a shard.

Null and empty texts are one piece with the end id alone; null ids and repeated rows are packed like any other row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lasting, materialise, passing
from .tokens import default_tokenizer, encoder

WINDOW = 2048
SHARD_TOKENS = 500_000
TASK_TOKENS = 8_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


class ShardIndex:
    """BM25 over a shard: postings by term, each with its document and weight; terms in half of all documents or more weigh nothing.

    corpus: the number of all documents, their mean length and each id's document frequency; without it those of the shard.
    """

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75, corpus: tuple[int, float, np.ndarray] | None = None):
        self.n = len(docs)
        sizes = np.array([len(x) for x in docs])
        doc = np.repeat(np.arange(self.n, dtype=np.int64), sizes)
        key, tf = np.unique((np.concatenate(docs).astype(np.int64) << 32) | doc, return_counts=True)
        term, self.doc = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        total, mean, everywhere = corpus or (self.n, sizes.mean(), None)
        among = df if everywhere is None else everywhere[self.terms]
        idf = np.log((total - among + 0.5) / (among + 0.5))
        of = np.repeat(np.arange(len(df)), df)
        self.weight = idf[of] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[self.doc] / max(1.0, mean)))
        self.first, self.df, useful = first, df, idf > 0
        order = np.argsort(self.doc, kind="stable")
        order = order[useful[of[order]]]
        self.doc_first = np.searchsorted(self.doc[order], np.arange(self.n + 1))
        self.doc_terms = of[order]

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document of the shard for the seed's terms."""
        t = self.doc_terms[self.doc_first[seed] : self.doc_first[seed + 1]]
        if not len(t):
            return np.zeros(self.n)
        n = self.df[t]
        at = np.repeat(self.first[t] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, corpus: tuple[int, float, np.ndarray] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    index, unused, pieces = ShardIndex(docs, corpus=corpus), np.ones(len(docs), bool), []
    sequence, used, order = 0, 0, 0
    seed = next_doc = -1
    ranked: list[int] = []
    for _ in range(len(docs)):
        if next_doc < 0:
            if seed >= 0 and not ranked:
                found = np.where(unused, index.scores(seed), -1.0)
                k = min(16, len(found) - 1)
                best = np.argpartition(-found, k)[: k + 1]
                ranked = [int(i) for i in best[np.lexsort((best, -found[best]))] if found[i] > 0][::-1]
            while ranked and not unused[ranked[-1]]:
                ranked.pop()
            if ranked:
                next_doc = ranked.pop()
            else:
                while not unused[order]:
                    order += 1
                next_doc = order
        unused[next_doc] = False
        if used == 0:
            seed, ranked = next_doc, []
        at, n = 0, len(docs[next_doc])
        while at < n:
            take = min(window - used, n - at)
            pieces.append((next_doc, at, take, sequence, used))
            at += take
            used += take
            if used == window:
                sequence, used, seed, ranked = sequence + 1, 0, next_doc if at < n else -1, []
        next_doc = -1
    return pieces


def corpus_statistics(ids: DataFrame, vocabulary: str) -> tuple[int, float, np.ndarray]:
    """(number, mean length, document frequency of each id) of all documents; arrays of a task and of the driver have the vocabulary's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(vocabulary).kind
        df, n, held = np.zeros(0, np.int64), 0, 0
        for b in batches:
            for x in b.column(0).to_pylist():
                terms = np.unique(np.frombuffer(x, kind))
                if len(terms) and terms[-1] >= len(df):
                    df = np.concatenate((df, np.zeros(int(terms[-1]) + 1 - len(df), np.int64)))
                df[terms] += 1
                n, held = n + 1, held + len(x) // np.dtype(kind).itemsize
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((terms, [-1, -2]))), pa.array(np.concatenate((df[terms], [n, held])))], ["id", "df"])

    found = dict(ids.select("ids").mapInArrow(count, "id long, df long").groupBy("id").agg(F.sum("df")).collect())
    everywhere = np.zeros(max(found, default=-1) + 1, np.int64)
    for k, n in found.items():
        if k >= 0:
            everywhere[k] = n
    total = found.get(-1, 0)
    return total, found.get(-2, 0) / max(1, total), everywhere


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each piece of each document: where it lies in the document and in which sequence.

    Texts are encoded where they are read; only packed ids are shuffled, once, by ranges of the lexical key.
    """
    vocabulary = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        mix = np.uint64(0x9E3779B97F4A7C15)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                ids = enc.encode(b.column(1).to_pylist())
                keys = []
                for x in ids:
                    h = (((np.frombuffer(x, enc.kind).astype(np.uint64) + np.uint64(1)) * mix) >> np.uint64(40)).astype(np.int64)
                    low = int(h.min())
                    above = h[h > low]
                    keys.append((low << 24) | (int(above.min()) if len(above) else low))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "lexical", "ids"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, base = encoder(vocabulary).kind, TaskContext.get().partitionId() << 40
        names: list[int | None] = []
        docs: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal base, held
            pieces = pack_shard(docs, window, corpus.value)
            last = pieces[-1][3]
            fill = np.bincount([p[3] for p in pieces], [p[2] for p in pieces]).astype(int)
            padded = [int(n) if n & (n - 1) == 0 else window for n in fill.tolist()]
            rows = [(names[d], s, n, zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes()), len(docs[d]), base + q, o, padded[q]) for d, s, n, q, o in pieces]
            base += last + 1
            names.clear(), docs.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], [x.split()[0] for x in PIECES.split(", ")])

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names.append(d)
                docs.append(np.frombuffer(x, kind))
                held += len(docs[-1])
                if held >= shard_tokens:
                    yield shard()
        if docs:
            yield shard()

    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with passing(spark):
        ids = materialise(rows.mapInArrow(encode, "doc_id long, lexical long, ids binary"), "pack-ids")
        counted = corpus_statistics(ids, vocabulary)
        corpus = spark.sparkContext.broadcast(counted)
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counted[0] * counted[1] / TASK_TOKENS))
        dealt = ids.repartitionByRange(n, "lexical", F.col("doc_id").asc_nulls_first()).sortWithinPartitions("lexical", F.col("doc_id").asc_nulls_first())
        return lasting(dealt.select("doc_id", "ids").mapInArrow(windows, PIECES), "pieces")
