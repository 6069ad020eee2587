"""The near copies that the pipeline's SimHash stage links and drops, against all pairs."""

import random
from itertools import combinations

import pyarrow.parquet as pq

from tidewright.llm import simhash

from .test_brute_force import DATA, classes


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def like(a, b):
    return (len(a & b) / len(a | b) if a | b else 1) >= 0.8


def check(spark, texts):
    held = {d: shingles(t) for d, t in texts.items()}
    links = [(a, b) for a, b in combinations(held, 2) if like(held[a], held[b])]
    want = classes(held, links)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {tuple(r) for r in simhash.near_components(table).collect()} == set(want.items())
    assert {r.doc_id for r in simhash.drop_near(table).select("doc_id").collect()} == set(want.values())
    return links


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    fp = {d: simhash.fingerprint(t, 5) & (1 << 64) - 1 for d, t in texts.items()}
    links = check(spark, texts)
    assert any((fp[a] ^ fp[b]).bit_count() > simhash.RADIUS for a, b in links)


def test_pairs_just_above_and_below_the_threshold_in_a_cluster(spark):
    rng, texts = random.Random(3), {}
    words = [f"w{k}" for k in range(3000)]
    for base in range(12):
        first = rng.choices(words, k=rng.choice((6, 9, 40, 300)))
        for copy in range(8):
            text = list(first)
            for _ in range(rng.randint(0, max(1, len(first) // 40))):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts[10 * base + copy] = " ".join(text) + " one same line at the end of many texts" * (base % 2)
    texts |= {900: "", 901: None, 902: " \n", 903: "one", 904: "ONE"}
    assert len(check(spark, texts)) > 20
    near = {frozenset((a, b)) for a, b in combinations(texts, 2) if 0.6 <= len(shingles(texts[a]) & shingles(texts[b])) / max(1, len(shingles(texts[a]) | shingles(texts[b]))) < 0.8}
    assert near


def test_recall_just_above_the_threshold_and_no_false_link(spark):
    """Pairs of likeness 0.8 to 0.85 and just under 0.8, of 30 to 400 words, with scattered and with whole-block edits; a link may be lost by chance only."""
    rng, docs, near, far = random.Random(8), [], [], []
    words = [f"w{k}" for k in range(20_000)]
    while len(near) < 400 or len(far) < 200:
        first = rng.choices(words, k=rng.randint(30, 400))
        text = list(first)
        if rng.random() < 0.5:
            for _ in range(rng.randint(1, max(1, len(first) // 35))):
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = text[: -max(1, round(len(text) * rng.uniform(0.1, 0.22)))]
        a, b = shingles(" ".join(first)), shingles(" ".join(text))
        j = len(a & b) / len(a | b)
        if 0.8 <= j < 0.85 and len(near) < 400 or 0.7 <= j < 0.8 and len(far) < 200:
            (near if j >= 0.8 else far).append((len(docs), len(docs) + 1))
            docs += [(len(docs), " ".join(first)), (len(docs) + 1, " ".join(text))]
    found = dict(tuple(r) for r in simhash.near_components(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert sum(found[a] == found[b] for a, b in near) >= 0.97 * len(near)
    assert not any(found[a] == found[b] for a, b in far) and len(found) == len(docs)


def test_a_large_cluster_and_a_template(spark):
    """Hundreds of near copies become one; texts that share a template but not four fifths of their shingles stay apart."""
    rng = random.Random(4)
    words = [f"v{k}" for k in range(5000)]
    base, frame = rng.choices(words, k=200), rng.choices(words, k=60)
    docs = []
    for k in range(300):
        text = list(base)
        text[rng.randrange(200)] = rng.choice(words)
        docs.append((k, " ".join(text)))
    for k in range(300):
        docs.append((1000 + k, " ".join(frame + rng.choices(words, k=25))))
    found = dict(tuple(r) for r in simhash.near_components(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert {found[k] for k in range(300)} == {0}
    assert all(found[1000 + k] == 1000 + k for k in range(300))


def test_a_cluster_on_both_sides_of_the_threshold_makes_no_row_for_each_pair(spark, monkeypatch):
    """Copies with one or three words changed: some are linked, most are not, all share shingles. Classes, against all pairs, in several units."""
    rng, texts = random.Random(6), {}
    words = [f"w{k}" for k in range(5000)]
    base = rng.choices(words, k=120)
    for k in range(200):
        text = list(base)
        for at in rng.sample(range(120), 1 if k % 10 == 0 else 3):
            text[at] = rng.choice(words)
        texts[k] = " ".join(text)
    pairs, named, verified, fetch = [], spark.sparkContext.accumulator(0), simhash._verified, simhash._fetch

    def counted(found, *more):
        pairs.append(found.count())
        return verified(found, *more)

    def tallied(batches):
        for b in fetch(batches):
            named.add(b.num_rows)
            yield b

    monkeypatch.setattr(simhash, "_verified", counted)
    monkeypatch.setattr(simhash, "_fetch", tallied)
    monkeypatch.setattr(simhash, "UNIT_TEXTS", 60, raising=False)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        found = dict(tuple(r) for r in simhash.near_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    held = {d: shingles(t) for d, t in texts.items()}
    links = [(a, b) for a, b in combinations(held, 2) if like(held[a], held[b])]
    assert found == classes(held, links)
    assert 10 < len(set(found.values())) and 100 < len(links) < 200 * 199 // 4
    assert pairs[-1] < 5 * 200  # of those left after the rounds
    assert 0 < named.value <= 20 * 200
