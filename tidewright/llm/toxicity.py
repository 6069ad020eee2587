"""Operator 5: toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model gives each sentence a probability from the words in it and their first three to six letters;
noisy-or makes the document's: 1 - product(1 - p). The weights are trained through the noisy-or from labels of documents only, and the
sentence probabilities then say where the offending sentences are.

Training rows are a bounded sample (`positives`, `negatives`: the ids with the smallest hashes; `longest`: code points of a text) of the labelled
rows; the features kept are those whose document counts differ significantly between the classes, `features` at most. The model is so of
bounded size and is sent to the executors. Texts of any length are scored whole.
Null and empty texts have no sentence and score 0; null labels and ids are not learned from; repeated labels count once, as toxic if any says so; without
labelled rows of both kinds every score is 0. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3
PREFIXES = (3, 4, 5, 6)


def word_features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class ToxicModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "cache": {}}

    def word(self, w: str) -> float:
        s = self.cache.get(w)
        if s is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            s = self.cache[w] = sum(self.weights.get(f, 0.0) for f in word_features(w))
        return s

    def sentence(self, sentence: str) -> float:
        """The log-odds of a sentence."""
        return self.bias + sum(map(self.word, set(WORD.findall(sentence))))

    def score(self, text: str | None) -> float:
        """Noisy-or over all sentences of the text."""
        if not text or not self.weights:
            return 0.0
        low = text.lower()
        known = self.cache.get
        kept = 0.0
        rest = math.log1p(math.exp(min(self.bias, 30.0)))
        for s in SENTENCE.findall(low):
            words = set(WORD.findall(s))
            z = 0.0
            for w in words:
                x = known(w)
                z += self.word(w) if x is None else x
            if words:
                kept += rest if z == 0.0 else float(np.logaddexp(0.0, self.bias + z))
        return -math.expm1(-kept)


def train(texts: list[str], labels: list[int], features: int = 5000, rounds: int = 300, l1: float = 2e-4) -> ToxicModel:
    """Fits the sentence weights by proximal Adam on the documents' log-likelihood."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return ToxicModel()
    counts = (Counter(), Counter())
    for text, t in zip(texts, labels):
        counts[t].update({f for w in set(WORD.findall(text.lower())) for f in word_features(w)})
    n1, n0 = y.sum(), len(y) - y.sum()

    def gain(f: str) -> float:
        """The G statistic of the feature against the label, signed by the direction."""
        a, b = counts[1][f], counts[0][f]
        p, total = (a + b) / (n1 + n0), 0.0
        for x, n in ((a, n1), (b, n0)):
            for o, e in ((x, n * p), (n - x, n * (1 - p))):
                total += o * math.log(o / e) if o and e else 0.0
        return 2 * total if a / n1 > b / n0 else -2 * total

    ranked = sorted(((gain(f), f) for f, a in counts[1].items() if a >= 4), reverse=True)
    names = [f for g, f in ranked[:features] if g > 15]
    if not names:
        return ToxicModel()
    at = {f: k for k, f in enumerate(names)}
    of: dict[str, list[int]] = {}
    doc, sent, feat, empty = [], [], [], np.zeros(len(y))
    for d, text in enumerate(texts):
        for s in SENTENCE.findall(text.lower()):
            words, hit = set(WORD.findall(s)), set()
            for w in words:
                if w not in of:
                    of[w] = [at[f] for f in word_features(w) if f in at]
                hit.update(of[w])
            if hit:
                sent += [len(doc)] * len(hit)
                feat += hit
                doc.append(d)
            elif words:
                empty[d] += 1
    doc, sent, feat = np.array(doc), np.array(sent), np.array(feat)
    theta = np.concatenate((np.zeros(len(names)), [-5.0]))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    size = np.where(y == 1, 0.5 / n1, 0.5 / n0) * 2 * (n1 / (n1 + n0) * (y == 1) + n0 / (n1 + n0) * (y == 0))
    for k in range(1, rounds + 1):
        w, b = theta[:-1], theta[-1]
        z = np.bincount(sent, w[feat], len(doc)) + b
        kept = np.bincount(doc, np.logaddexp(0, z), len(y)) + empty * np.logaddexp(0, b)
        p = -np.expm1(-kept)
        pull = size * np.where(y == 1, -(1 - p) / np.maximum(p, 1e-9), 1.0)
        ps = 1 / (1 + np.exp(-z))
        gz = pull[doc] * ps
        grad = np.concatenate((np.bincount(feat, gz[sent], len(names)), [gz.sum() + (pull * empty).sum() / (1 + math.exp(-b))]))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        theta -= step
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - 0.1 * l1, 0)
    return ToxicModel({f: float(x) for f, x in zip(names, theta[:-1]) if x}, float(theta[-1]))


def training_rows(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = 2000, negatives: int = 4000, longest: int = 50_000) -> ToxicModel:
    rows = training_rows(labels).withColumn("tie", F.xxhash64("doc_id"))
    picked = rows.where("toxic > 0").orderBy("tie", "doc_id").limit(positives).unionByName(rows.where("toxic = 0").orderBy("tie", "doc_id").limit(negatives))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id")
    texts = texts.where("text is not null").where(F.length("text") <= longest)
    got = sorted({(r.doc_id, r.text, int(r.toxic > 0)) for r in texts.toLocalIterator()})
    return train([t for _, t, _ in got], [y for _, _, y in got])


def score_column(model: ToxicModel, text):
    """A column with the documents' scores."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([model.score(t) for t in b], dtype="float64")

    return score(text)


def offending(model: ToxicModel, text: str) -> list[tuple[int, int, float]]:
    """(start, end, probability) of each sentence with a word, in order; code points."""
    out = []
    for s in SENTENCE.finditer(text):
        low = s[0].lower()
        if WORD.search(low):
            out.append((s.start(), s.end(), 1 / (1 + math.exp(-max(-700.0, model.sentence(low))))))
    return out


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, worst_start, worst_end, n_sentences) of every row.

    The last three say where a text that is predicted offends: its most offending sentence, the first of equals, and how many sentences have a
    probability of `threshold` or more; they are null for other texts.
    """
    model = fit(docs, labels, id_col, text_col)

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            scores = np.array([model.score(t) for t in texts], float)
            where: list[tuple] = []
            for t, p in zip(texts, scores):
                found = offending(model, t) if p >= threshold else []
                worst = max(found, key=lambda x: x[2], default=None)
                where.append((worst[0], worst[1], sum(x[2] >= threshold for x in found)) if worst else (None, None, None))
            placed = [pa.array(x, pa.int64()) for x in zip(*where)] if where else [pa.array([], pa.int64())] * 3
            columns = [b.column(0), b.column(1), pa.array(scores), pa.array((scores >= threshold).astype("i4")), *placed]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCORED.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batch, _SCORED)


_SCORED = "doc_id long, held_out boolean, score double, predicted int, worst_start long, worst_end long, n_sentences long"


def toxic_sentences(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, sentence, score): the sentences at or over the threshold, in code points."""

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            rows = [(d, a, e, t[a:e], p) for d, t in texts for a, e, p in offending(model, t or "") if p >= threshold]
            if rows:
                d, a, e, s, p = zip(*rows)
                columns = [pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(e, pa.int64()), pa.array(s), pa.array(p, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "sentence", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batch, "doc_id long, start long, end long, sentence string, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows under the threshold, with their columns."""
    return docs.where(score_column(fit(docs, labels, id_col, text_col), F.col(text_col)) < threshold)
