"""Where toxic texts offend, against plain Python, and on sentences put into clean texts; held-out rows of a table with few labels."""

import math
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from tidewright.llm import queries, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))


def probability(model, sentence):
    words = set(re.findall(r"[^\W\d_]+", sentence.lower()))
    z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in ["=" + w, *(w[:n] for n in (3, 4, 5, 6) if len(w) >= n)])
    return 1 / (1 + math.exp(-z)) if words else 0.0


def test_scores_and_places_against_plain_python(spark, model):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    rows = {r.doc_id: r for r in queries.op5_toxicity(spark, DATA).collect()}
    assert set(rows) == set(texts) and any(r.predicted for r in rows.values())
    for d, t in texts.items():
        found = [(m.start(), m.end(), probability(model, m[0])) for m in re.finditer(r"[^.!?\n]+", t)]
        score = 1 - math.prod(1 - p for *_, p in found)
        assert rows[d].score == pytest.approx(score, abs=1e-6)
        if not rows[d].predicted:
            assert rows[d].worst_start is None and rows[d].n_sentences is None
            continue
        best = max(p for *_, p in found)
        place = next(p for a, e, p in found if (a, e) == (rows[d].worst_start, rows[d].worst_end))
        assert place == pytest.approx(best, abs=1e-9)
        assert rows[d].n_sentences == sum(p >= 0.3 for *_, p in found)


def test_a_sentence_put_into_a_clean_text_is_found(spark, model):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    clean = [t for t in texts.values() if t.count(".") > 5 and model.score(t) < 0.05][:40]
    words = sorted((f[1:] for f, w in model.weights.items() if f[0] == "="), key=lambda f: -model.word(f))[:8]
    rng, docs, want = random.Random(3), [], {}
    for k, t in enumerate(clean):
        parts = t.split(".")
        at = rng.randrange(len(parts) - 1)
        put = " ".join(rng.sample(words, 3))
        parts.insert(at, put)
        want[k] = sum(len(p) + 1 for p in parts[:at])
        docs.append((k, ".".join(parts)))
    docs += [(100, None), (101, ""), (102, "...\n!!"), (None, clean[0])]
    found = toxicity.toxic_sentences(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    hit = {r.doc_id for r in found if want.get(r.doc_id) == r.start}
    assert len(clean) == 40 and hit == set(want) and len(found) <= len(hit) + 2
    assert all(dict(docs)[r.doc_id][r.start : r.end] == r.sentence and r.score >= 0.5 for r in found)


def test_held_out_rows_where_labels_are_few(spark):
    """37 toxic rows in four languages to learn from and 14 to be found: no clean row may be flagged, and 9 are found. More would need more labels."""
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    held = [(labels[r.doc_id], r.predicted) for r in queries.op5_toxicity(spark, DATA).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and labels.get(r.doc_id) is not None]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    assert len(toxic) == 14 and sum(toxic) >= 9 and sum(clean) == 0
