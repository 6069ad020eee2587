"""Operator 6: SimHash fingerprints and near duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments A, B (21 bits) and C (22 bits). Of two fingerprints at distance 4 or less, either A differs
in at most one bit, or B does, or C is equal. So each distinct fingerprint is put into the table of each segment, and for A and B also under the
values with one zero bit set: of two values one bit apart the lower one's small ball meets the other. Fingerprints that meet are compared in full.
A value shared by more than HOT fingerprints is refined by the same scheme over the bits outside its segment, so tables stay small when
the input grows and no link is lost. Each table value emits the links of a spanning star, not all pairs.

Null text and text without words have fingerprint zero, which links like any other. Repeated rows and null ids get a row each; a component in
which all ids are null has component null. Other columns are ignored; an empty table gives no rows.

drop_near, the stage of the pipeline, links texts whose sets of five-word shingles have a Jaccard index of 0.8 or more: near_components finds them by the
same scheme over a fingerprint of 256 bits and then compares the sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, lasting, materialise, passing

SEGMENTS = ((0, 21, True), (21, 21, True), (42, 22, False))
RADIUS = 4
HOT = 8192
BLOCK = 1 << 15
WIDE = 4
SEGMENT = 18
PER_WORD = 3
TABLES = WIDE * PER_WORD
NEXT_RADIUS = 32
WIDE_RADIUS, SMALL_SET, SMALL_RADIUS = 60, 32, 72
SHORT = 64
ROUNDS = 3
PART_ENTRIES = 500_000
PAIRED = 32
UNIT_TEXTS, UNIT_SHINGLES = 512, 2_000_000
KNOWN = np.uint32(1 << 31)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line, h = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(line, 42)], np.uint64)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends]
    return np.fromiter((h(line[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(parts) - words + 1)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of a whole text, as a signed 64-bit number."""
    hashes = shingle_hashes(text or "", words)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, words) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batch, "doc_id long, fp long")


def table_rows(df: DataFrame, key: str, value: str, segments) -> DataFrame:
    """(key.., fp): df's rows under each segment of `value` and under the small balls."""
    def slots(k: int, at: int, n: int, ball: bool):
        seg = F.shiftrightunsigned(F.col(value), at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
        values = F.array(seg)
        if ball:
            masks = F.array(*[F.lit(1 << i).cast("long") for i in range(n)])
            values = F.concat(values, F.transform(F.filter(masks, lambda m: seg.bitwiseAND(m) == 0), lambda m: seg.bitwiseOR(m)))
        return F.transform(values, lambda v: v + F.lit(k << 32).cast("long"))

    found = F.explode(F.concat(*[slots(k, *s) for k, s in enumerate(segments)])).alias("slot")
    return df.select(key, "fp", found) if key else df.select("fp", found)


def _spread(fps: np.ndarray) -> list[tuple[int, int]]:
    """Star links of the components among fingerprints that met, comparing each reached one with those not yet reached."""
    left, links = np.unique(fps), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = np.array([root])
        while len(todo) and len(left):
            near = np.zeros(len(left), bool)
            step = max(1, (1 << 22) // len(left))
            for k in range(0, len(todo), step):
                near |= (np.bitwise_count(todo[k : k + step, None] ^ left[None, :]) <= RADIUS).any(axis=0)
            todo, left = left[near], left[~near]
            links += [(int(x), int(root)) for x in todo]
    return links


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (slot columns.., fp) that are sorted by slot. Short runs are compared together, by their distance in the order."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
        size = np.diff(edge)
        out = []
        short = np.repeat((size > 1) & (size <= 64), size)
        run = np.repeat(np.arange(len(size)), size)[short]
        f = fp[short]
        for gap in range(1, int(size[(size > 1) & (size <= 64)].max(initial=1))):
            near = (run[gap:] == run[:-gap]) & (np.bitwise_count(f[gap:] ^ f[:-gap]) <= RADIUS)
            if near.any():
                out.append(np.stack((f[gap:][near], f[:-gap][near])))
        for k in np.flatnonzero(size > 64):
            if found := _spread(fp[edge[k] : edge[k + 1]]):
                out.append(np.array(found, np.uint64).T)
        both = np.unique(np.concatenate(out, axis=1), axis=1).view(np.int64) if out else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["u", "v"])

    held: list[pa.RecordBatch] = []
    rows = 0

    def split(last: bool):
        nonlocal held, rows
        table = pa.Table.from_batches(held)
        key = np.stack([table.column(k).to_numpy() for k in range(table.num_columns - 1)], axis=1)
        fp = table.column(table.num_columns - 1).to_numpy().view(np.uint64)
        cut = len(key) if last else int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
        held, rows = ([table.slice(cut).combine_chunks().to_batches()[0]] if cut < len(key) else []), len(key) - cut
        return links(key[:cut], fp[:cut]) if cut else None

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
            if rows >= 100_000 and (found := split(False)) is not None:
                yield found
    if held:
        yield split(True)


def near_links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v): links whose components are those of all pairs of distinct fingerprints `fp` at distance 4 or less."""
    rows = table_rows(fps, "", "fp", SEGMENTS)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded = materialise(rows.groupBy("slot").count().where(F.col("count") > hot).select("slot"), "crowded")
    busy = not crowded.isEmpty()
    plain = rows.join(crowded, "slot", "left_anti") if busy else rows
    found = plain.select("slot", "fp").repartition(n, "slot").sortWithinPartitions("slot", "fp").mapInArrow(_meet, "u long, v long")
    if busy:
        inside = rows.join(crowded, "slot")
        seg = F.shiftright("slot", 32)
        low = lambda n: F.col("fp").bitwiseAND(F.lit((1 << n) - 1).cast("long"))
        rest = F.when(seg == 0, F.shiftrightunsigned("fp", 21)).when(seg == 1, F.shiftleft(F.shiftrightunsigned("fp", 42), 21).bitwiseOR(low(21))).otherwise(low(42))
        inside = inside.select(F.col("slot").alias("outer"), "fp", rest.alias("rest"))
        deep = table_rows(inside, "outer", "rest", ((0, 14, True), (14, 14, True), (28, 15, False)))
        found = found.unionByName(deep.select("outer", "slot", "fp").repartition(n, "outer", "slot").sortWithinPartitions("outer", "slot", "fp").mapInArrow(_meet, "u long, v long"))
    return found


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    with passing(df.sparkSession):
        docs = lasting(fingerprints(df, id_col, text_col, words), "fingerprints")
        classes = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
        comps = connected_components(materialise(near_links(classes.select("fp")), "near"))
        placed = classes.join(comps, classes.fp == comps.node, "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
        placed = lasting(placed, "placed")
    names = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "comp").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def members(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(text or "", words))


def wide_fingerprint(held: np.ndarray) -> np.ndarray:
    """A SimHash of 64 * WIDE bits over a set of shingles."""
    ones = np.zeros(64 * WIDE, np.int64)
    for k in range(0, len(held), BLOCK):
        bits = []
        for w in range(WIDE):
            z = held[k : k + BLOCK] + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            bits.append(z ^ (z >> np.uint64(31)))
        ones += np.unpackbits(np.stack(bits, axis=1).view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(held)).view(np.int64)


def _pack(text: str | None) -> bytes:
    return zlib.compress((text or "").encode("utf-8", "replace"), 1)


def _unpack(data: bytes, words: int) -> np.ndarray:
    return members(zlib.decompress(data).decode(), words)


_PRINT = [f"w{k}" for k in range(WIDE)]
_READ = "doc_id long, key long, n long, " + ", ".join(f"{w} long" for w in _PRINT) + ", packed binary"


def _read(words: int):
    """A row for each text: the hash of its set of shingles, the set's size and wide fingerprint, and the packed text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                texts = b.column(1).to_pylist()
                held = [members(t, words) for t in texts]
                keys = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in held], np.uint64).view(np.int64)
                wide = np.stack([wide_fingerprint(x) for x in held])
                columns = [b.column(0), pa.array(keys), pa.array([len(x) for x in held], pa.int64()), *(pa.array(wide[:, w]) for w in range(WIDE)), pa.array([_pack(t) for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _READ.split(", ")])

    return read


_ENTRY = np.dtype([("slot", "<u4"), ("key", "<i8"), ("other", "<u8"), ("third", "<u8")])


def _tables(parts: int, tables: range):
    """From classes (key, known, w0..) the entries of these segment tables, as one block of bytes for each of `parts` ranges of mixed slots."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                b = whole.slice(k, 4096)
                key, wide = b.column(0).to_numpy(), np.stack([c.to_numpy() for c in b.columns[2:]]).view(np.uint64)
                known, out = b.column(1).to_numpy(zero_copy_only=False), []
                for t in tables:
                    word, low = divmod(t, PER_WORD)
                    at = (wide[word] >> np.uint64(low * SEGMENT) & np.uint64((1 << SEGMENT) - 1)).astype(np.uint32)
                    for mask in [0, *(1 << i for i in range(SEGMENT))]:
                        held = at & np.uint32(mask) == 0  # the segment itself, and its small ball where a zero bit is set
                        entry = np.empty(int(held.sum()), _ENTRY)
                        entry["slot"], entry["key"] = np.uint32(t << SEGMENT | mask) | at[held] | np.where(known[held], KNOWN, np.uint32(0)), key[held]
                        entry["other"], entry["third"] = wide[(word + 1) % WIDE][held], wide[(word + 2) % WIDE][held]
                        out.append(entry)
                entries = np.concatenate(out)
                part = ((entries["slot"] & ~KNOWN) * np.uint32(0x9E3779B1)).astype(np.uint64) * np.uint64(parts) >> np.uint64(32)
                order = np.argsort(part, kind="stable")
                entries, part = entries[order], part[order]
                edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
                blocks = [entries[a:e].tobytes() for a, e in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]].astype(np.int32)), pa.array(blocks, pa.binary())], ["part", "entries"])

    return deal


def _met(slot: np.ndarray, other: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Which entries, sorted by slot, have another in their slot whose two next words are near."""
    edge = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True])))
    size = np.diff(edge)
    hit = np.zeros(len(slot), bool)
    few = np.flatnonzero(np.repeat((size > 1) & (size <= SHORT), size))
    run, x, y = np.repeat(np.arange(len(size)), size)[few], other[few], third[few]
    for gap in range(1, int(size[(size > 1) & (size <= SHORT)].max(initial=1))):
        at = np.flatnonzero((run[gap:] == run[:-gap]) & (np.bitwise_count(x[gap:] ^ x[:-gap]) + np.bitwise_count(y[gap:] ^ y[:-gap]) <= NEXT_RADIUS))
        hit[few[at]] = hit[few[at + gap]] = True
    for k in np.flatnonzero(size > SHORT):
        a, e = edge[k], edge[k + 1]
        left, step = np.arange(a, e), 1
        while len(left):  # what a row meets need not be asked again, so a large group is done after a few rows
            ask, left = left[:step], left[step:]
            near = np.bitwise_count(other[ask, None] ^ other[None, a:e]) + np.bitwise_count(third[ask, None] ^ third[None, a:e]) <= NEXT_RADIUS
            near[np.arange(len(ask)), ask - a] = False
            hit[ask] |= near.any(axis=1)
            hit[a:e] |= near.any(axis=0)
            left = left[~hit[left]]
            step = min(2 * step, max(1, (1 << 21) // int(e - a)))
    return hit


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks sorted by part: the keys of entries that meet another one and are not yet known to."""

    def meet(blocks: list[bytes]) -> pa.RecordBatch:
        e = np.frombuffer(b"".join(blocks), _ENTRY)
        slot = e["slot"] & ~KNOWN
        order = np.argsort(slot, kind="stable")
        e = e[order]
        hit = _met(slot[order], *(np.ascontiguousarray(e[x]) for x in ("other", "third"))) & (e["slot"] < KNOWN)
        return pa.RecordBatch.from_arrays([pa.array(np.unique(e["key"][hit]))], ["key"])

    held, last = [], None
    for b in batches:
        for part, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if part != last and held:
                yield meet(held)
                held = []
            held.append(block)
            last = part
    if held:
        yield meet(held)


def _shingles(words: int):
    """(key, n, sh): every shingle of the sets of rows (key, packed)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                held = [_unpack(x, words) for x in b.column(1).to_pylist()]
                n = np.array([len(x) for x in held])
                columns = [np.repeat(b.column(0).to_numpy(), n), np.repeat(n, n), np.concatenate(held).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "n", "sh"])

    return spread


def _rare(texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """(key, n, sh, place): of each set's n - ceil(threshold * n) + 1 shingles that fewest sets hold, those that more than one holds; place is the rank of all.

    Two sets that reach the threshold share one of them. Texts that share no more than what many share, and have a fifth of their own, give nothing.
    """
    spots = materialise(texts.mapInArrow(_shingles(words), "key long, n long, sh long"), "member-shingles")
    holders = materialise(spots.groupBy("sh").agg(F.count("*").alias("holders")).where("holders > 1"), "holders")
    own = Window.partitionBy("key")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("holders", "sh")) - 1  # what only one set holds comes first
    rare = spots.join(holders, "sh").withColumn("place", place)
    return rare.where(F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9)).select("key", "n", "sh", "place")


def _can_reach(threshold: float) -> Column:
    """Whether sets of nu and nv shingles whose first common one stands at place_u and place_v can reach the threshold: by their sizes, and by what is left."""
    left = 1 + F.least(F.col("nu") - 1 - F.col("place_u"), F.col("nv") - 1 - F.col("place_v"))
    sized = F.least("nu", "nv") >= F.lit(threshold) * F.greatest("nu", "nv") - 1e-9
    return sized & (left >= F.lit(threshold / (1 + threshold)) * (F.col("nu") + F.col("nv")) - 1e-9)


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, threshold: float, name: str) -> DataFrame:
    """The pairs (u, v) whose complete fingerprints are near and whose sets have a Jaccard index of `threshold` or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.empty(0, np.uint64)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b, good = whole.slice(k, 256), []
                for u, tu, tv in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    if u != last:
                        last, x = u, _unpack(tu, words)
                    y = _unpack(tv, words)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both / (len(x) + len(y) - both) >= threshold)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in b.columns[:2]], ["u", "v"])

    of = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), *(F.col(w).alias(w + x) for w in _PRINT))
    apart = sum((F.bit_count(F.col(w + "u").bitwiseXOR(F.col(w + "v"))) for w in _PRINT), F.lit(0))
    sized = F.least("nu", "nv") >= F.lit(threshold) * F.greatest("nu", "nv") - 1e-9
    radius = F.when(F.least("nu", "nv") < SMALL_SET, SMALL_RADIUS).otherwise(WIDE_RADIUS)
    pairs = pairs.select("u", "v").distinct().join(of("u"), "u").join(of("v"), "v").where(sized & (apart <= radius)).select("u", "v")
    pairs = materialise(pairs, f"{name}-met")
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    held = materialise(texts.join(wanted, "key", "left_semi"), f"{name}-texts")
    a, b = held.select(F.col("key").alias("u"), F.col("packed").alias("tu")), held.select(F.col("key").alias("v"), F.col("packed").alias("tv"))
    return materialise(pairs.join(b, "v").join(a, "u").select("u", "v", "tu", "tv").mapInArrow(check, "u long, v long"), f"{name}-links")


def _united(keys: np.ndarray, comps: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links (u, v) between sets of different components, and of different sides if there are two, that unite all that such pairs unite."""
    m, n = len(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(m), n)
    _, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[at] > 1
    number = (np.cumsum(held > 1) - 1)[at[shared]]
    owner, order = owner[shared], np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    both = np.zeros((m, m))
    for k in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        a, e = np.searchsorted(number, (k, k + 4096))
        has = np.zeros((m, 4096), np.float32)
        has[owner[a:e], number[a:e] - k] = 1
        both += has @ has.T
    near = both / (n[:, None] + n[None, :] - both) >= threshold
    if side.min() != side.max():
        near &= side[:, None] != side[None, :]
    comps, links = np.unique(comps, return_inverse=True)[1], []
    for u in range(m):
        met = np.flatnonzero(near[u] & (comps != comps[u]))
        others, first = np.unique(comps[met], return_index=True)
        if len(met):
            links += [(int(keys[u]), int(keys[v])) for v in met[first]]
            comps[np.isin(comps, others)] = comps[u]
    return links


def _units(words: int, threshold: float):
    """(u, v): _united of each unit, from rows (grp, a, b, block, key, comp, packed) sorted by unit."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> pa.RecordBatch:
            block, key, comp = (np.array(x) for x in list(zip(*held))[:3])
            found = _united(key, comp, block, [x[3] for x in held], threshold)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        held, last = [], None
        for b in batches:
            for *unit, block, key, comp, packed in zip(*(c.to_pylist() for c in b.columns)):
                if unit != last and held:
                    yield links()
                    held = []
                held.append((block, key, comp, _unpack(packed, words)))
                last = unit
        if held:
            yield links()

    return compare


def _crowd_links(crowd: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """(u, v): links that unite what pairs of rows (key, n, sh, comp) that reach the threshold and share a shingle unite.

    Texts that shingles connect are a group. A group is cut into blocks by the key's hash; each two blocks, and each block, are a unit, compared in one
    task by their sets, all of them. So rows grow with a group's texts times its blocks, not its pairs.
    """
    n = int(crowd.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = materialise(crowd.groupBy("sh").agg(F.min("key").alias("root")), "crowd-roots")
    groups = connected_components(crowd.join(roots, "sh").select("key", "root").distinct(), "key", "root").select(F.col("node").alias("key"), F.col("comp").alias("grp"))
    held = materialise(crowd.select("key", "n", "comp").distinct().join(groups, "key"), "crowd")
    blocks = F.greatest(F.ceil(F.count("*") / UNIT_TEXTS), F.ceil(F.sum("n") / UNIT_SHINGLES)).cast("int")
    sizes = materialise(held.groupBy("grp").agg(blocks.alias("blocks")), "crowd-sizes")
    dealt = held.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.select("grp", "block", "key", "comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    units = dealt.join(texts, "key").select("grp", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "block", "key", "comp", "packed")
    return materialise(units.repartition(n, "grp", "a", "b").sortWithinPartitions("grp", "a", "b", "key").mapInArrow(_units(words, threshold), "u long, v long"), "crowd-links")


def _near_classes(df: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, and (key, least, comp) of every class of equal sets of shingles: its smallest id and its component."""
    spark, n = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialise(rows.mapInArrow(_read(words), _READ), "shingle-sets")
    classes = sets.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), *(F.first(w).alias(w) for w in _PRINT))
    classes = materialise(classes, "shingle-classes")
    # those that the first word's tables find are named once, there; in the others' they only meet the rest
    members, known, size = None, classes.withColumn("known", F.lit(False)), classes.count()
    for tables in (range(PER_WORD), range(PER_WORD, TABLES)):
        parts = max(n, size * len(tables) * (SEGMENT // 2 + 1) // PART_ENTRIES)
        blocks = known.select("key", "known", *_PRINT).mapInArrow(_tables(parts, tables), "part int, entries binary").repartition(n, "part").sortWithinPartitions("part")
        found = materialise(blocks.mapInArrow(_fetch, "key long").distinct(), "near-members")
        members = members.unionByName(found) if members else found
        known = classes.join(found.withColumn("known", F.lit(True)), "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    texts = sets.select("key", "packed").join(members, "key", "left_semi").groupBy("key").agg(F.first("packed").alias("packed"))
    texts = materialise(texts, "member-texts")
    rare = materialise(_rare(texts, words, threshold), "rare-shingles")

    # each with one of those that hold a shingle, another one in each round
    links, comps, turn = classes.select(F.col("key").alias("u"), F.col("key").alias("v")).limit(0), classes.select("key", F.col("key").alias("comp")).limit(0), 0
    while True:
        placed = materialise(rare.join(comps, "key", "left").select("key", "n", "sh", "place", F.coalesce("comp", "key").alias("comp")), "placed-shingles")
        apart = materialise(placed.groupBy("sh").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("holders")).where("a <> b").select("sh", "holders"), "apart")
        placed = materialise(placed.join(apart, "sh"), "apart-shingles")
        side = lambda x: placed.select("sh", *(F.col(c).alias(to) for c, to in (("key", x), ("n", f"n{x}"), ("place", f"place_{x}"), ("comp", f"c{x}"))))
        if turn == ROUNDS:
            break
        drawn = F.min_by(F.struct("u", "nu", "place_u", "cu"), F.xxhash64(F.lit(turn), "u")).alias("at")
        roots = materialise(side("u").groupBy("sh").agg(drawn).select("sh", "at.*"), "roots")
        found = _verified(side("v").join(roots, "sh").where(F.col("cu") != F.col("cv")).where(_can_reach(threshold)), classes, texts, words, threshold, "near")
        if found.isEmpty():
            break
        links, turn = links.unionByName(found), turn + 1
        comps = materialise(connected_components(links).withColumnRenamed("node", "key"), "near-comps")

    # every pair of those that are still apart: of shingles with few holders as rows, of the others in units of many texts
    crowd, placed = placed.where(F.col("holders") > PAIRED).select("key", "n", "sh", "comp"), placed.where(F.col("holders") <= PAIRED)
    rest = side("u").join(side("v"), "sh").where((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv"))).where(_can_reach(threshold))
    more = _verified(rest, classes, texts, words, threshold, "rest")
    if not crowd.isEmpty():
        more = more.unionByName(_crowd_links(crowd, texts, words, threshold))
    if not more.isEmpty():
        comps = connected_components(links.unionByName(more)).withColumnRenamed("node", "key")
    return sets.select("doc_id", "key"), materialise(classes.join(comps, "key", "left").select("key", "least", F.coalesce("comp", "key").alias("comp")), "near-placed")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row, under links of texts whose sets of shingles have a Jaccard index of `threshold` or more.

    Equal sets are one class. Each class has a SimHash of 64 * WIDE bits, PER_WORD segments of SEGMENT bits a word, and a table a segment; it is put under the
    segment and under the small ball of values with one zero bit set. Classes that share a table value and whose next two words are near are candidates.
    Links are lost by chance only, at every size of the table alike: at 0.8 some 15 bits of 100 differ, and two such texts meet in none of the 12
    tables 6 times in 1000. Candidates are paired where they share one of their rare shingles and can still reach the threshold: in rounds with one
    holder of the shingle from another component, ROUNDS of them at most, then all that are still apart: where a shingle has more than PAIRED
    holders by _crowd_links, which compares sets in units of up to 2 * UNIT_TEXTS texts and gives the links that unite them; so a cluster of near copies makes
    no row for each of its pairs. Other pairs are compared by their complete fingerprints and then by the sets themselves, so no link is false. A text without
    words is only like others without words.
    """
    with passing(df.sparkSession):
        sets, placed = _near_classes(df, id_col, text_col, words, threshold)
        named = placed.join(placed.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("key", "component_id")
        return lasting(sets.join(named, "key").select("doc_id", "component_id"), "near-components")


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """df without the rows whose component of near_components has a smaller id; a component in which all ids are null stays as it is.

    Rows are told apart by their id: where an id repeats, all its rows stay if one of them does.
    """
    with passing(df.sparkSession):
        _, placed = _near_classes(df, id_col, text_col, words, threshold)
        stays = lasting(placed.groupBy("comp").agg(F.min("least").alias("__keep")).select("__keep").distinct(), "stays")
    return df.join(stays, F.col(id_col).cast("long").eqNullSafe(F.col("__keep")), "left_semi")
