"""Operator 7: repeated passages by sharded suffix arrays.

Every string of LENGTH bytes has an anchor: the first of its KGRAM-byte strings with the least hash. Equal strings have equal anchors at the same
place, so strings are dealt to shards by the anchor's hash and a shard holds all strings that can be equal. Consecutive strings with the
same anchor form one context, the bytes from the first one's start to the last one's end. Contexts whose anchor is found once are not
repeated; where all contexts of an anchor are the same bytes, all their strings are; the others, one copy of each, go to a shard. There each is cut to
what it can share: equal strings lie around their anchors alike, so none reaches further from it than the context agrees with some other one of its anchor.
What is left of a shard's contexts is sorted by induced sorting (suffix_array) and permuted common prefixes tell which strings stand at two places or more.
An anchor with more than HOT different contexts is dealt on: each of its contexts is cut anew by anchors under another hash, equal pieces become one,
and the pieces' spans are carried back; so on for LEVELS levels. Only strings that share all these anchors with more than HOT different neighbours
are dealt by the hash of the whole string and compared by 128 bits of it, so one anchor never fills a task.

Bytes of the UTF-8 text are counted; null text is empty; matches do not cross documents; texts shorter than LENGTH lose nothing. Repeated rows
are repeats of each other. Null ids get their row like others. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lasting, materialise, passing
from .suffix_array import permuted_lcp, suffix_array

LENGTH = 400
KGRAM = 40
HOT = 4000
LEVELS = 6
SHARD_BYTES = 1 << 20
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_UP, _DOWN = _powers(_BASE, BLOCK + 2 * LENGTH + 2), _powers(_INVERSE, BLOCK + 2 * LENGTH + 2)


def _kgram_hashes(x: np.ndarray, level: int = 0) -> np.ndarray:
    """A mixed 64-bit hash of every KGRAM bytes of at most BLOCK + 2 * LENGTH bytes; another one for each level."""
    n = len(x)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _UP[:n], dtype=np.uint64)))
    h = (total[KGRAM:] - total[:-KGRAM]) * _DOWN[: n - KGRAM + 1]
    h ^= np.uint64(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _first_least(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the position of the first of those with the least top 44 bits; h has fewer than 2**20 values."""
    n, low = len(h) - w + 1, np.uint64((1 << 20) - 1)
    blocks = -(-len(h) // w)
    pad = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    pad[: len(h)] = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    grid = pad.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & low).astype(np.int64)


def contexts(data: bytes, level: int = 0) -> list[tuple[int, int, int]]:
    """(anchor hash, first start, number of starts) of each context of a whole text, in order."""
    n, w, out = len(data), LENGTH - KGRAM + 1, []
    x = np.frombuffer(data, np.uint8)
    for base in range(0, n - LENGTH + 1, BLOCK):
        part = x[base : base + BLOCK + LENGTH - 1]
        h = _kgram_hashes(part, level)
        at = _first_least(h, w)
        edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        count = np.diff(np.concatenate((edge, [len(at)])))
        out += zip(h[at[edge]].view(np.int64).tolist(), (base + edge).tolist(), count.tolist())
    return out


def repeated_starts(group: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """For contexts (bytes, starts, copies): which of each one's starts begin a string that begins elsewhere too.

    One suffix array over all of them, with a value of its own between contexts.
    """
    sizes = [len(c) for c, _, _ in group]
    s = np.empty(sum(sizes) + len(group) + 1, np.int64)
    weight = np.zeros(len(s), np.int64)
    at, firsts = 0, []
    for (c, starts, copies), n in zip(group, sizes):
        s[at : at + n] = np.frombuffer(c, np.uint8).astype(np.int64) + 2
        s[at + n] = 1
        weight[at : at + starts] = copies
        firsts.append(at)
        at += n + 1
    s[at] = 0
    sa = suffix_array(s)
    lcp = permuted_lcp(s, sa)
    run = np.cumsum(lcp[sa] < LENGTH)
    total = np.bincount(run, weight[sa])
    again = np.zeros(len(s), bool)
    again[sa] = total[run] > 1
    return [again[a : a + k] for a, (_, k, _) in zip(firsts, group)]


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_OCC = "h long, c long, tk binary, doc_id long, start int, n int"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each context of each text."""
    for b in batches:
        h, c, tk, doc, start, n = [], [], [], [], [], []
        for d, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            data = text.as_buffer().to_pybytes()
            if len(data) < LENGTH:
                continue
            for a, s, k in contexts(data):
                h.append(a)
                c.append(xxhash.xxh3_64_intdigest(data[s : s + k - 1 + LENGTH]) - (1 << 63))
                start.append(s)
                n.append(k)
            tk += [t] * (len(h) - len(tk))
            doc += [d] * (len(h) - len(doc))
        if h:
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(tk, pa.binary()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())], [x.split()[0] for x in _OCC.split(", ")])


_RAW = "h long, c long, copies long, n int, raw binary"
_PIECE = f"ph long, pc long, k int, {_RAW}"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, (_, kind) in zip(zip(*rows), named)], [name for name, _ in named])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted contexts: (h, c, copies, n, raw) from (text, wanted)."""
    for b in batches:
        rows = []
        for text, wanted in zip(b.column(0), b.column(1).to_pylist()):
            data = text.as_buffer()
            for w in wanted:
                rows.append((w["h"], w["c"], w["copies"], w["n"], data.slice(w["start"], w["n"] - 1 + LENGTH).to_pybytes()))
        if rows:
            yield _batch(rows, _RAW)


def _recut(level: int):
    """The pieces of crowded contexts under another level's anchors: where in which context, and (h, c, copies, n, raw) like a context."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, c, copies, _, raw in zip(*(b.column(k).to_pylist() for k in range(5))):
                for a, k, n in contexts(raw, level):
                    piece = raw[k : k + n - 1 + LENGTH]
                    deep = xxhash.xxh3_64_intdigest(h.to_bytes(8, "little", signed=True) + a.to_bytes(8, "little", signed=True)) - (1 << 63)
                    rows.append((h, c, k, deep, xxhash.xxh3_64_intdigest(piece) - (1 << 63), copies, n, piece))
            if rows:
                yield _batch(rows, _PIECE)

    return cut


def _alike(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def _shared(raws: list[bytes], level: int) -> list[tuple[int, int]]:
    """For different contexts of one anchor: the range of each one's bytes that holds all its strings found in another one; (0, 0) if none can be.

    In the order of what follows the anchor, and of what precedes it read backwards, the longest agreement is with a neighbour.
    """
    low = np.uint64((1 << 20) - 1)
    at = [int((_kgram_hashes(np.frombuffer(x, np.uint8)[:LENGTH], level) & ~low).argmin()) for x in raws]
    reach = []
    for sides in ([x[:k][::-1] for x, k in zip(raws, at)], [x[k:] for x, k in zip(raws, at)]):
        most = [0] * len(raws)
        order = sorted(range(len(raws)), key=sides.__getitem__)
        for u, v in zip(order, order[1:]):
            n = _alike(sides[u], sides[v])
            most[u], most[v] = max(most[u], n), max(most[v], n)
        reach.append(most)
    return [(k - a, k + b) if a + b >= LENGTH else (0, 0) for k, a, b in zip(at, *reach)]


def _shards(batches: Iterator[pa.RecordBatch], level: int = 0) -> Iterator[pa.RecordBatch]:
    """(h, c, spans) of contexts that are sorted by h, an anchor of this level; a shard is some SHARD_BYTES of whole anchors, as far as they are shared."""
    held: list[tuple[int, int, int, int, int, bytes]] = []
    group: list[tuple[int, int, int, int, bytes]] = []
    size = 0

    def close() -> None:
        nonlocal group, size
        for (h, c, copies, n, raw), (a, b) in zip(group, _shared([x[4] for x in group], level)):
            if b or copies > 1:
                held.append((h, c, copies, n, a, raw[a:b]))
                size += b - a + 100
        group = []

    def shard() -> pa.RecordBatch:
        sorted_ones = iter(repeated_starts([(part, len(part) - LENGTH + 1, copies) for _, _, copies, _, _, part in held if part]))
        flags = []
        for _, _, copies, n, a, part in held:
            again = np.full(n, copies > 1)
            if part:
                again[a : a + len(part) - LENGTH + 1] |= next(sorted_ones)
            flags.append(again)
        return _span_rows([x[:2] for x in held], flags)

    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(5))):
            if group and row[0] != group[-1][0]:
                close()
                if size >= SHARD_BYTES:
                    yield shard()
                    held, size = [], 0
            group.append(row)
    if group:
        close()
    if held:
        yield shard()


def _span_rows(keys: list[tuple[int, int]], flags: list[np.ndarray]) -> pa.RecordBatch:
    h, c, spans = [], [], []
    for (a, b), f in zip(keys, flags):
        if f.any():
            h.append(a)
            c.append(b)
            spans.append([{"a": x, "b": y} for x, y in _spans(f)])
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(spans, kind)], ["h", "c", "spans"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, k, s1, s2, copies): the hash of every string of the contexts of crowded anchors."""
    for b in batches:
        for h, c, copies, n, raw in zip(*(b.column(k).to_pylist() for k in range(5))):
            d = [xxhash.xxh3_128_intdigest(raw[k : k + LENGTH]) for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.int64()), pa.array([c] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([(x >> 64) - (1 << 63) for x in d], pa.int64()), pa.array([(x & (1 << 64) - 1) - (1 << 63) for x in d], pa.int64()), pa.array([copies] * n, pa.int64())], ["h", "c", "k", "s1", "s2", "copies"])


_SPANS = "array<struct<a:int,b:int>>"


def _moved(by) -> Column:
    return F.transform("spans", lambda x: F.struct((by + x.a).cast("int").alias("a"), (by + x.b).cast("int").alias("b"))).cast(_SPANS)


def _span_table(raw: DataFrame, anchors: DataFrame, hot: int, level: int = 1) -> DataFrame:
    """(h, c, spans) of contexts (h, c, copies, n, raw): which of their strings stand at two places or more. anchors: each context's h, once."""
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded = materialise(anchors.groupBy("h").count().where(F.col("count") > hot).select("h"), "crowded")
    busy = not crowded.isEmpty()
    raw = materialise(raw, "context-bytes") if busy else raw
    plain = raw.join(crowded, "h", "left_anti").select("h", "c", "copies", "n", "raw") if busy else raw
    # (h, c) twice only when rows repeat an id and a text: the second adds nothing
    spans = plain.repartition(parts, "h").sortWithinPartitions("h", "c").mapInArrow(_dedup_shards(level - 1), f"h long, c long, spans {_SPANS}")
    if not busy:
        return spans
    inside = raw.dropDuplicates(["h", "c"]).join(crowded, "h").select("h", "c", "copies", "n", "raw")
    if level < LEVELS:
        pieces = materialise(inside.mapInArrow(_recut(level), _PIECE), "pieces")
        alike = pieces.groupBy("h", "c").agg(F.sum("copies").alias("copies"), F.first("n").alias("n"), F.first("raw").alias("raw"))
        alike = materialise(alike, "alike")
        found = _span_table(alike.select("h", "c", "copies", "n", "raw"), alike.select("h"), hot, level + 1)
        back = pieces.select("h", "c", "ph", "pc", "k").join(found, ["h", "c"])
        return spans.unionByName(back.select(F.col("ph").alias("h"), F.col("pc").alias("c"), _moved(F.col("k")).alias("spans")))
    strings = materialise(inside.mapInArrow(_strings, "h long, c long, k int, s1 long, s2 long, copies long"), "strings")
    again = strings.groupBy("s1", "s2").agg(F.sum("copies").alias("all")).where(F.col("all") > 1).select("s1", "s2")
    hit = strings.join(again, ["s1", "s2"]).groupBy("h", "c").agg(F.collect_list(F.struct(F.col("k").alias("a"), (F.col("k") + 1).alias("b"))).cast(_SPANS).alias("spans"))
    return spans.unionByName(hit)


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, tk) of every row, and (tk, covers): the byte ranges to remove of each text that has any, not yet merged."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("tk"))
    occ = materialise(docs.select("doc_id", "tk", "text").mapInArrow(_occurrences, _OCC), "contexts")
    anchors = occ.groupBy("h").agg(F.count("*").alias("all"), F.min("c").alias("c1"), F.max("c").alias("c2")).where(F.col("all") > 1)
    # written, so that the join deals both sides anew and a hot anchor can be split
    anchors = materialise(anchors.select("h", (F.col("c1") != F.col("c2")).alias("mixed")), "anchors")
    occ = materialise(occ.join(anchors, "h"), "repeated-anchors")
    classes = occ.groupBy("h", "c", "mixed").agg(F.count("*").alias("copies"), F.min(F.struct("tk", "doc_id", "start", "n")).alias("at"))
    classes = materialise(classes.select("h", "c", "mixed", "copies", "at.*"), "classes")
    same = classes.where(~F.col("mixed")).select("h", "c", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).cast(_SPANS).alias("spans"))
    wanted = classes.where("mixed").groupBy("tk", "doc_id").agg(F.collect_list(F.struct("h", "c", "copies", "start", "n")).alias("wanted"))
    found = docs.alias("d").join(wanted.alias("w"), (F.col("d.tk") == F.col("w.tk")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("text", "wanted")
    spans = same.unionByName(_span_table(found.mapInArrow(_extract, _RAW), classes.where("mixed").select("h"), hot))
    covers = occ.select("h", "c", "tk", "start").join(spans, ["h", "c"])
    covers = covers.select("tk", F.transform("spans", lambda x: F.struct((F.col("start") + x.a).alias("a"), (F.col("start") + x.b - 1 + LENGTH).alias("b"))).alias("covers"))
    covers = covers.groupBy("tk").agg(F.flatten(F.collect_set("covers")).alias("covers"))
    return docs, lasting(covers, "covers")


def _dedup_shards(level: int):
    """_shards of rows sorted by h and c, of each two only one."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def distinct() -> Iterator[pa.RecordBatch]:
            last = None
            for b in batches:
                h, c = b.column(0).to_pylist(), b.column(1).to_pylist()
                keep = []
                for k in zip(h, c):
                    keep.append(k != last)
                    last = k
                yield b.filter(pa.array(keep))

        yield from _shards(distinct(), level)

    return shards


def merged(covers: list[dict] | None) -> list[tuple[int, int]]:
    """Disjoint, maximal byte ranges in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in covers or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with_bytes adds the ranges and the remaining bytes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t, covers in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                data = t.as_buffer().to_pybytes()
                spans = merged(covers)
                kept = cut(data, spans)
                row = (d, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                rows.append((*row, [{"a": x, "b": y} for x, y in spans], kept) if with_bytes else row)
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.binary()]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names[: len(cols)])

    with passing(df.sparkSession):
        docs, covers = repeated(df, id_col, text_col, hot)
    joined = docs.join(covers, "tk", "left").select("doc_id", "text", "covers")
    more = f", spans {_SPANS}, kept binary" if with_bytes else ""
    return joined.mapInArrow(apply, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
