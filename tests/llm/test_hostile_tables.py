"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns whose names clash."""

import pytest

from tidewright.llm import exact_dedup, mixing, packing, quality, queries, secrets, simhash, spotsigs, suffix_dedup, token_planes, toxicity

LONG = " ".join(f"word{k} the river" for k in range(30_000))
TEXTS = ["", None, " \t\n", "one", "the quiet harbour of the old town", "the quiet harbour of the old town", LONG, LONG, "x" * 50_000, "\U0001f600 " * 40, "\x00\x1f", "you are a worthless fool"]
ROWS = [(k if k % 5 else None, t, ("a", None, "b")[k % 3], "clash", 7, "clash", 0.5) for k, t in enumerate(TEXTS)] * 2
SCHEMA = "doc_id long, text string, source string, digest string, tokens int, fingerprint string, weight double"
LABELS = [(1, 1, 0), (2, None, 1), (None, 1, 1), (3, 0, None), (4, 1, 0), (4, 1, 0), (7, 0, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    def make(rows, labels):
        return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    return make(ROWS, LABELS), make([], [])


PER_ROW = {
    "exact_dedup": lambda d, x: exact_dedup.exact_dedup(d),
    "toxicity": lambda d, x: toxicity.toxicity(d, x),
    "simhash": lambda d, x: simhash.simhash_components(d),
    "suffix_dedup": lambda d, x: suffix_dedup.remove_repeats(d),
    "token_files": lambda d, x: token_planes.token_files(d),
    "resample": lambda d, x: quality.resample(d, x),
    "spotsigs": lambda d, x: spotsigs.spotsigs_edits(d),
}


@pytest.mark.parametrize("name", list(PER_ROW))
def test_a_row_for_each_row(tables, name):
    (docs, labels), (none, no_labels) = tables
    got = PER_ROW[name](docs, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert PER_ROW[name](none, no_labels).count() == 0
    assert len(PER_ROW[name](docs, no_labels).collect()) == len(ROWS)


def test_packing(tables):
    (docs, _), (none, _) = tables
    rows = packing.pack(docs).collect()
    assert sum(r.start == 0 for r in rows) == len(ROWS) and all(0 < r.length <= 2048 for r in rows)
    assert packing.pack(none).count() == 0


def test_mixing(tables):
    (docs, _), (none, _) = tables
    mixed = mixing.mix(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns
    rows = mixed.collect()
    assert sum(r.text == LONG for r in rows) >= 4 and {r.source for r in rows} == {"a", "b", None}
    assert mixing.mix(none).count() == 0 and mixing.mixture(none).count() == 0
    nothing = docs.where("text is null or trim(text) = ''")
    assert mixing.mix(nothing).count() == nothing.count()  # sources without any token are taken once


def test_secrets(tables):
    (docs, _), (none, _) = tables
    assert secrets.scan_secrets(docs).where("is_secret").where("value = 'word1'").count() == 0
    assert secrets.scan_secrets(none).count() == 0


def test_stages_keep_columns(tables):
    (docs, labels), (none, no_labels) = tables
    for stage in (lambda d, x: toxicity.drop_toxic(d, x), lambda d, x: exact_dedup.drop_exact(d), lambda d, x: simhash.drop_near(d)):
        kept = stage(docs, labels)
        assert kept.columns == docs.columns and 0 < kept.count() <= len(ROWS)
        assert stage(none, no_labels).count() == 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))
