"""Each stage of the pipeline against plain Python over what its predecessor kept, and the whole of it."""

from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline as pipeline
import pytest

from tidewright.llm import queries
from tidewright.llm.common import read_table

from .test_brute_force import DATA, SPACE, classes
from .test_near_copies import like, shingles


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = read_table(spark, DATA, "documents").cache(), []
    out.append(docs)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == out[0].columns
        out.append(docs)
    return [{r.doc_id: r.text or "" for r in d.collect()} for d in out] + [Counter(r.doc_id for r in docs.collect())]


def test_toxic_documents_go(spark, kept):
    clean = {r.doc_id for r in queries.op5_toxicity(spark, DATA).collect() if not r.predicted}
    assert set(kept[1]) == clean and len(clean) > 0.8 * len(kept[0])


def test_one_of_each_group_of_copies_stays(kept):
    groups = defaultdict(list)
    for d, t in kept[1].items():
        groups[t.translate({ord(c): None for c in SPACE})].append((-len(t), d))
    assert set(kept[2]) == {min(g)[1] for g in groups.values()}


def test_one_of_each_group_of_near_copies_stays(kept):
    held = {d: shingles(t) for d, t in kept[2].items()}
    comp = classes(held, [(a, b) for a, b in combinations(held, 2) if like(held[a], held[b])])
    assert set(kept[3]) == set(comp.values())


def test_mixing_drops_none(kept):
    assert set(kept[4]) == set(kept[3]) and max(kept[5].values()) <= 2


def test_all_that_is_left_is_packed(spark, kept):
    rows, packed = pipeline.run(spark, DATA).collect(), Counter()
    tokens = {r.doc_id: r.doc_tokens for r in rows}
    for r in rows:
        packed[r.doc_id] += r.length
    assert packed == {d: n * tokens[d] for d, n in kept[5].items()}
