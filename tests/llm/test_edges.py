import hashlib

from tidewright.llm import exact_dedup, simhash, suffix_dedup

LONG = " ".join(f"w{k}" for k in range(200))
ROWS = [(1, "a b", "x"), (2, "ab ", "x"), (None, "ab", None), (3, None, "y"), (4, "", "y"), (5, LONG, "y"), (5, LONG, "y"), (6, "head " + LONG, "z")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, digest string")


def test_exact_dedup(spark):
    got = sorted(tuple(r)[:4] for r in exact_dedup.exact_dedup(frame(spark)).collect() if r.doc_id is not None)
    assert got == [(1, 1, 3, True), (2, 1, 3, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True)]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_simhash(spark):
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_components(frame(spark)).collect()}
    assert {(3, 3), (4, 3), (5, 5)} <= got


def test_suffix_dedup(spark):
    rows = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark)).collect()}
    n = len(LONG)
    assert (5, n, n, 1, hashlib.sha256(b"").hexdigest()) in rows
    assert (6, n + 5, n, 1, hashlib.sha256(b"head ").hexdigest()) in rows
    assert (3, 0, 0, 0, hashlib.sha256(b"").hexdigest()) in rows
