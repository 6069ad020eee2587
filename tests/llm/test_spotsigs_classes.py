"""Pairs of fingerprint classes where ids are null, repeat, or stand for different texts, against all pairs."""

from itertools import combinations

import pytest

from tidewright.llm import spotsigs

from .test_brute_force import likeness, signatures

WORDS = "harbour lantern meadow orchard granite velvet copper willow thunder saffron pebble walnut compass ribbon glacier marble".split()
BASE = "the " + " the ".join(WORDS)
SWAPPED = BASE.replace("granite", "basalt")
ROWS = [(1, BASE), (None, BASE), (None, SWAPPED), (None, SWAPPED + " and more"), (2, "the quiet river"), (2, SWAPPED), (3, None), (None, ""), (4, "!!"), (5, "the quiet river")]


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_links_of_rows_without_an_id_of_their_own(spark, threshold):
    pairs, members = spotsigs.spotsigs_pairs(spark.createDataFrame(ROWS, "doc_id long, text string"), threshold=threshold)
    members = members.collect()
    assert sorted((r.doc_id or 0) for r in members) == sorted((d or 0) for d, _ in ROWS)
    sets = {frozenset(signatures(t or "")) for _, t in ROWS}
    assert len({r.key for r in members}) == len(sets)
    want = sorted(likeness(a, b) for a, b in combinations(sets, 2) if a and b and likeness(a, b) >= threshold)
    got = pairs.collect()
    assert sorted(r.likeness for r in got) == pytest.approx(want) and len({frozenset((r.key_a, r.key_b)) for r in got}) == len(got)
    ids = {r.key: r.class_id for r in members}
    assert all((r.class_a, r.class_b) == (ids[r.key_a], ids[r.key_b]) for r in got)


def test_an_empty_table(spark):
    pairs, members = spotsigs.spotsigs_pairs(spark.createDataFrame([], "doc_id long, text string"))
    assert pairs.count() == members.count() == 0
