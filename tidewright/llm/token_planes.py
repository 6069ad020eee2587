"""Operator 8: token ids in binary files, blocks of ids transposed into bit or byte planes, each compressed with zstandard.

A file: magic, then for each chunk of CHUNK_IDS ids its compressed planes; then a footer (zstandard over the arrays doc_id, null flags,
tokens per document, and the chunk index: offset, ids, length of each plane) and a trailer with the footer's length and the magic.
Any chunk can be read alone by its index entry.

Null ids sort first and stay null; a null text is empty and gives the end id alone; rows that repeat a doc_id stay, ordered by
a hash of their text; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialise, scratch
from .tokens import default_tokenizer, encoder

MAGIC = b"TWPLANE1"
CHUNK_IDS = 1 << 16


def to_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The planes of unsigned ids of `width` bytes, most significant first."""
    raw = ids.astype(f">u{width}").view(np.uint8).reshape(-1, width)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(width)]
    spread = np.unpackbits(raw, axis=1)
    return [np.packbits(spread[:, k]).tobytes() for k in range(8 * width)]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    if bits:
        spread = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(spread, axis=1)
    else:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(raw).reshape(-1).view(f">u{width}").astype(np.uint32)


class PlaneWriter:
    """Streams ids into a file; holds one chunk and the footer's arrays."""

    def __init__(self, out, width: int, bits: bool = False, level: int = 3):
        import zstandard

        self.out, self.width, self.bits, self.pack = out, width, bits, zstandard.ZstdCompressor(level=level)
        self.at, self.buffer, self.held = len(MAGIC), [], 0
        self.chunks: list[list[int]] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // self.width)
        self.buffer.append(ids)
        self.held += len(ids) // self.width
        if self.held >= CHUNK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids, k = np.frombuffer(b"".join(self.buffer), f"<u{self.width}"), 0
        while len(ids) - k >= (1 if last else CHUNK_IDS):
            part = ids[k : k + CHUNK_IDS]
            planes = [self.pack.compress(p) for p in to_planes(part, self.width, self.bits)]
            self.chunks.append([self.at, len(part), *map(len, planes)])
            for p in planes:
                self.out.write(p)
                self.at += len(p)
            k += len(part)
        self.buffer, self.held = [ids[k:].tobytes()], len(ids) - k

    def close(self) -> None:
        self._flush(True)
        n, planes = len(self.docs), self.width * (8 if self.bits else 1)
        head = struct.pack("<QQIII", n, len(self.chunks), self.width, self.bits, planes)
        body = b"".join((np.array([d or 0 for d in self.docs], "<i8").tobytes(), np.array([d is None for d in self.docs], np.uint8).tobytes(), np.array(self.sizes, "<u8").tobytes(), np.array(self.chunks, "<u8").reshape(-1).tobytes()))
        footer = self.pack.compress(head + body)
        self.out.write(footer)
        self.out.write(struct.pack("<Q", len(footer)) + MAGIC)


class PlaneReader:
    """Reads the footer at once and chunks one by one."""

    def __init__(self, src, size: int):
        import zstandard

        self.src, self.unpack = src, zstandard.ZstdDecompressor()
        src.seek(size - 16)
        length, magic = struct.unpack("<Q8s", src.read(16))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        src.seek(size - 16 - length)
        raw = self.unpack.decompress(src.read(length))
        n, chunks, self.width, bits, planes = struct.unpack_from("<QQIII", raw)
        self.bits, at = bool(bits), struct.calcsize("<QQIII")
        ids, nulls = np.frombuffer(raw, "<i8", n, at), np.frombuffer(raw, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, nulls)]
        self.sizes = np.frombuffer(raw, "<u8", n, at + 9 * n).astype(np.int64)
        self.chunks = np.frombuffer(raw, "<u8", chunks * (planes + 2), at + 17 * n).reshape(chunks, planes + 2).astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *lengths = self.chunks[k].tolist()
        self.src.seek(at)
        raw, planes, pos = self.src.read(sum(lengths)), [], 0
        for x in lengths:
            planes.append(self.unpack.decompress(raw[pos : pos + x]))
            pos += x
        return from_planes(planes, n, self.width, self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(doc_id, start in the file, pieces of its ids), holding one chunk; a document's pieces are used before the next."""
        k, have, start = -1, np.empty(0, np.uint32), 0
        for doc, n in zip(self.doc_ids, self.sizes.tolist()):
            parts, left = [], n
            while left:
                if not len(have):
                    k += 1
                    have = self.chunk(k)
                parts.append(have[:left])
                left -= len(parts[-1])
                have = have[len(parts[-1]) :]
            yield doc, start, iter(parts)
            start += n


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, bits: bool = False) -> DataFrame:
    """Writes the ids of every whole text in ascending id order, a file for each range of ids; returns (file_no, path, n_docs, n_tokens).

    One shuffle, of the text by ranges of the id. An attempt of a task writes a file of its own name and only the
    successful attempt's name is returned, so a lost executor leaves no half file in use.
    """
    vocabulary = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, out, enc, name, no = None, None, encoder(vocabulary), "", TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                fs, at = filesystem(path)
                fs.create_dir(at, recursive=True)
                name = f"ids-{no:06d}-{uuid.uuid4().hex[:8]}.twp"
                out = fs.open_output_stream(f"{at}/{name}")
                writer = PlaneWriter(out, enc.kind.itemsize, bits)
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                for d, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    writer.add(d, ids)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([no], pa.int32()), "path": [f"{path}/{name}"], "n_docs": [len(writer.docs)], "n_tokens": [sum(writer.sizes)]})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    return materialise(parts.mapInArrow(write, "file_no int, path string, n_docs long, n_tokens long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; starts count over all files in order.

    The list of files, one row for each task that wrote, is the only thing that comes to the driver.
    """
    spark, start, listed = files.sparkSession, 0, []
    for r in sorted(files.collect(), key=lambda r: r.file_no):
        listed.append((r.path, start))
        start += r.n_tokens
    schema = "path string, first long"
    if not listed:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = filesystem(p)
                with fs.open_input_file(at) as src:
                    rows, reader = [], PlaneReader(src, src.size())
                    for (doc, begin, parts), n in zip(reader.documents(), reader.sizes.tolist()):
                        crc = 0
                        for x in parts:
                            crc = zlib.crc32(x.astype("<u4").tobytes(), crc)
                        rows.append((doc, first + begin, n, crc))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(spark.sparkContext.parallelize(listed, len(listed)), schema).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, **options) -> DataFrame:
    """Writes the files in the shared folder and reads them back."""
    return read_token_files(write_token_files(df, scratch(df.sparkSession, "tokens"), **options))
