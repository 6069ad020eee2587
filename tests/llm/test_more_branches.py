"""Branches that the whole-table tests do not enter: bit planes, budgets, heavy digests, crowded table values, and the pipeline on hostile tables."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from tidewright.llm import exact_dedup, mixing, simhash, token_planes
from tidewright.llm.common import scratch
from tidewright.llm.tokens import default_tokenizer, encoder

from .test_brute_force import DATA
from .test_hostile_tables import LABELS, ROWS, SCHEMA


def test_bit_planes_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bits = token_planes.write_token_files(docs, scratch(spark, "bits"), bits=True)
    enc = encoder(default_tokenizer())
    rows = {r.doc_id: enc.encode([r.text])[0] for r in docs.collect()}
    want, start = set(), 0
    for d in sorted(rows):
        ids = np.frombuffer(rows[d], enc.kind)
        want.add((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in token_planes.read_token_files(bits).collect()} == want


@pytest.mark.parametrize("share", [0.2, 1.0, 2.5])
def test_a_budget_is_met(spark, share):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    total = docs.select(mixing.token_count("text").alias("n")).groupBy().sum().first()[0]
    longest = docs.select(mixing.token_count("text").alias("n")).groupBy().max().first()[0]
    rows = mixing.mixture(docs, repeat_limit=None, target_entropy=0.5, budget=int(share * total)).collect()
    sources = {r.source for r in rows}
    assert abs(sum(r.n_tokens for r in rows) - share * total) <= len(sources) * (longest + 1)
    passes = Counter((r.doc_id, r.epoch) for r in rows)
    assert set(passes.values()) == {1}


@pytest.mark.parametrize("counters", [4, 64, 4096])
def test_heavy_digests_change_nothing(spark, counters):
    rng = random.Random(2)
    rows = [(k, rng.choice(["same text", "other  text", "third", f"own {k}", f"own {k % 50}"]) + " " * rng.randint(0, 2)) for k in range(1500)]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), counters=counters).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(t.replace(" ", ""), []).append((-len(t), d))
    want = {(d, min(g)[1], len(g), d == min(g)[1]) for g in groups.values() for _, d in g}
    assert {tuple(r)[:4] for r in found} == want


@pytest.mark.parametrize("hot", [1, 4, 8192])
def test_crowded_table_values_lose_no_link(spark, hot):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for base in list(prints):
        for _ in range(10):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << b
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(prints)]
    found = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot=hot).collect()
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        assert ((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 4
        parent[root(r.u)] = root(r.v)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert root(a) == root(b)


def test_the_pipeline_on_hostile_and_empty_tables(spark, tmp_path):
    for name, rows, labels in (("hostile", ROWS, LABELS), ("empty", [], [])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(out) == bool(rows) and all(0 < r.length <= 2048 for r in out)
