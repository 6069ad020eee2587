"""Suffix arrays against sorting, and repeated passages with crowded anchors against all strings."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import suffix_array as sa
from tidewright.llm import suffix_dedup


@pytest.mark.parametrize("small", [1, 3, 1024])
def test_suffix_arrays_of_any_alphabet(monkeypatch, small):
    monkeypatch.setattr(sa, "SMALL_ALPHABET", small)
    rng = np.random.default_rng(5)
    for trial in range(120):
        s = rng.integers(1, rng.choice((2, 4, 3000)) + 1, rng.integers(1, 80))
        s = np.concatenate((np.tile(s[:4], 9) if trial % 5 == 0 else s, [0])).astype(np.int64)
        found = sa.suffix_array(s)
        assert found.tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())
        lcp = sa.permuted_lcp(s, found)
        for before, p in zip(found.tolist(), found[1:].tolist()):
            a, b = s[before:].tolist(), s[p:].tolist()
            assert lcp[p] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def removed(texts, n=suffix_dedup.LENGTH):
    seen, data = {}, {d: (t or "").encode() for d, t in texts}
    for x in data.values():
        for k in range(len(x) - n + 1):
            seen[x[k : k + n]] = seen.get(x[k : k + n], 0) + 1
    for d, x in data.items():
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                gone[k : k + n] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(x) else 0
        yield d, len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("hot", [1, 5, suffix_dedup.HOT])
def test_a_passage_in_many_documents(spark, hot):
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefgh äö") for _ in range(n))
    short, long, end = some(300), some(450), some(395)
    texts = [(k, some(rng.randint(0, 300)) + (short, long, end, "", short + long)[k % 5] + some(rng.randint(0, 300))) for k in range(60)]
    texts += [(100, None), (101, ""), (102, long[:200] + long[200:]), (103, "=" * 900), (104, "=" * 399), (105, (some(30) * 40)[:1000]), (106, end + "x" * 5), (107, "y" * 4 + end)]
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), hot=hot).collect()
    assert {tuple(r) for r in rows} == set(removed(texts)) and len(rows) == len(texts)


@pytest.mark.parametrize("level", [0, 2])
def test_only_what_contexts_of_an_anchor_share_is_sorted(monkeypatch, level):
    """Contexts of one anchor that agree on 360, 399, 400, 401 and 500 bytes about it; the same flags as with all bytes in one suffix array, and fewer sorted."""
    rng, rows = random.Random(2), []
    for shared in (360, 399, 400, 401, 500) * 6:
        passage = rng.randbytes(shared)
        for copies in (1, 1, 3):
            data = rng.randbytes(300) + passage + rng.randbytes(300)
            rows += [(h, len(rows) + k, copies, n, data[s : s + n - 1 + suffix_dedup.LENGTH]) for k, (h, s, n) in enumerate(suffix_dedup.contexts(data, level))]
    rows.sort()
    every = suffix_dedup.repeated_starts([(raw, n, copies) for _, _, copies, n, raw in rows])
    want = {(h, c): suffix_dedup._spans(f) for (h, c, *_), f in zip(rows, every) if f.any()}
    sizes, sort = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda s: sizes.append(len(s)) or sort(s))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["h", "c", "copies", "n", "raw"])
    found = [r for b in suffix_dedup._shards(iter([batch.slice(0, 100), batch.slice(100)]), *[level] * (level > 0)) for r in b.to_pylist()]
    assert {(r["h"], r["c"]): [(x["a"], x["b"]) for x in r["spans"]] for r in found} == want and len(found) == len(want)
    assert any(c == 1 and (h, k) in want for h, k, c, *_ in rows)
    assert 0 < sum(sizes) < 0.4 * sum(len(x[4]) for x in rows)
