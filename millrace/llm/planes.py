"""Operator 7, token-id output by bit-plane shuffling.

A file holds the ids of a run of documents in ascending doc_id order:

    magic "MRPLANE1"
    chunks: the planes of one block of at most BLOCK ids, each compressed by zstandard
    index:  zstandard of JSON {"block", "kind", "ids", "chunks": [[offset, ids, [plane sizes]]], "docs": offset and sizes}
    tail:   index offset and size as two little-endian 64-bit integers, magic

Plane p of a block has bit p ("bit") or byte p ("byte") of each id, so planes that are all zero
or change little compress to almost nothing. Planes above the highest used one aren't stored.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first; repeated rows
each keep their own entry, ordered by a hash of the text among equal ids, then as they come; a file holds
about FILE_BYTES of text at most, whatever number of rows have one id; very long texts are encoded whole and
span blocks; an empty table gives no file and no row; columns other than doc_id (a whole number) and text aren't read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import files
from ..cluster import scratch, ship, stored
from .memory import enter
from .tokens import default_vocabulary, encoder
from .words import slices

MAGIC = b"MRPLANE1"
BLOCK = 1 << 16
END_ID = 2
FILE_BYTES = 256 << 20


def split_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, lowest first, without unused high ones."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        return [octets[:, p].tobytes() for p in range((top + 7) // 8)]
    return [np.packbits((ids >> np.uint32(p)) & np.uint32(1)).tobytes() for p in range(top)]


def join_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    ids = np.zeros(n, dtype=np.uint32)
    for p, plane in enumerate(planes):
        raw = np.frombuffer(plane, dtype=np.uint8)
        ids |= (raw.astype(np.uint32) << np.uint32(8 * p)) if kind == "byte" else (np.unpackbits(raw, count=n).astype(np.uint32) << np.uint32(p))
    return ids


class Writer:
    def __init__(self, uri: str, kind: str = "byte", block: int = BLOCK, level: int = 3):
        import zstandard

        self.file, self.kind, self.block = files.create(uri), kind, block
        self.squeeze = zstandard.ZstdCompressor(level=level).compress
        self.file.write(MAGIC)
        self.at, self.total, self.chunks = len(MAGIC), 0, []
        self.pending: list[np.ndarray] = []
        self.waiting = 0
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents and their ids, one after the other."""
        self.doc_ids += doc_ids
        self.sizes += sizes.tolist()
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, dtype=np.uint32)
        end = len(ids) if last else len(ids) - len(ids) % self.block
        for i in range(0, end, self.block):
            part = ids[i : min(i + self.block, end)]
            planes = [self.squeeze(x) for x in split_planes(part, self.kind)]
            self.chunks.append([self.at, len(part), [len(x) for x in planes]])
            for x in planes:
                self.file.write(x)
                self.at += len(x)
        self.total += end
        self.pending, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        keys = np.array([0 if x is None else x for x in self.doc_ids], dtype="<i8")
        table = [self.squeeze(np.diff(keys, prepend=np.int64(0)).tobytes()), self.squeeze(np.array(self.sizes, dtype="<i8").tobytes())]
        nulls = [i for i, x in enumerate(self.doc_ids) if x is None]
        docs = [self.at, len(keys), [len(x) for x in table], nulls]
        index = self.squeeze(json.dumps({"block": self.block, "kind": self.kind, "ids": self.total, "chunks": self.chunks, "docs": docs}).encode())
        self.file.write(b"".join(table) + index + struct.pack("<QQ", self.at + sum(map(len, table)), len(index)) + MAGIC)
        self.file.close()


class Reader:
    """A file's documents; chunk(i) reads one block of ids without the others."""

    def __init__(self, uri: str):
        import zstandard

        self.file, self.expand = files.read(uri), zstandard.ZstdDecompressor().decompress
        self.file.seek(0, 2)
        self.file.seek(self.file.tell() - 24)
        at, size, magic = struct.unpack("<QQ8s", self.file.read(24))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a whole plane file")
        self.file.seek(at)
        self.index = json.loads(self.expand(self.file.read(size)))
        at, n, (keys, sizes), nulls = self.index["docs"]
        self.file.seek(at)
        self.doc_ids: list[int | None] = np.cumsum(np.frombuffer(self.expand(self.file.read(keys)), dtype="<i8")).tolist()
        self.sizes = np.frombuffer(self.expand(self.file.read(sizes)), dtype="<i8")
        for i in nulls:
            self.doc_ids[i] = None

    def chunk(self, i: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][i]
        self.file.seek(at)
        return join_planes([self.expand(self.file.read(k)) for k in sizes], n, self.index["kind"])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, first id's number in this file, ids; holds one document and one block at a time."""
        chunks = iter(range(len(self.index["chunks"])))
        rest, start = np.zeros(0, dtype=np.uint32), 0
        for doc_id, n in zip(self.doc_ids, self.sizes.tolist(), strict=True):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.chunk(next(chunks)))
                have += len(parts[-1])
            whole = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc_id, start, whole[:n]
            rest, start = whole[n:], start + n

    def close(self) -> None:
        self.file.close()


def write_planes(docs: DataFrame, folder: str, vocabulary: str | None = None, kind: str = "byte", block: int = BLOCK, end_id: int = END_ID) -> DataFrame:
    """Write the ids of documents (doc_id, text) as plane files below folder; return the committed files as (part, path, docs, ids), part ascending with doc_id.

    A range shuffle on doc_id gives each task a run of ids; equal ids are told apart by a hash of the text
    and a row number, so that they need not meet in one task. A task that is run again writes a file of
    another name, and only the one whose row reaches the result counts.
    """
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")]
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = -(-total // FILE_BYTES)
    many = parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (rows.repartitionByRange(parts, *order) if many else rows.repartitionByRange(*order)).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        part, uri, out = TaskContext.get().partitionId(), "", None
        for batch in batches:
            for piece in slices(batch, "text", 3 << 20):
                if out is None:
                    uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.planes"
                    out = Writer(uri, kind, block)
                ids, bounds = encoder(path).encode(piece.column("text"))
                whole = np.insert(ids, bounds[1:], end_id).astype(np.uint32)
                out.add(piece.column("doc_id").to_pylist(), np.diff(bounds) + 1, whole)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [uri], "docs": [len(out.sizes)], "ids": [out.total]})

    return stored(ordered.mapInArrow(write, "part long, path string, docs long, ids long"), "planes-index")


def read_planes(index: DataFrame) -> DataFrame:
    """Read plane files back: per document doc_id, start (ids of all before it), n_tokens, ids_crc32."""
    spark = index.sparkSession
    ship(spark)
    base, rows = 0, []
    for x in sorted(index.collect(), key=lambda x: x["part"]):  # one row per file
        rows.append((x["path"], base))
        base += x["ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        for batch in batches:
            for uri, first in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                source, out = Reader(uri), []
                for doc_id, start, ids in source.documents():
                    out.append((doc_id, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 20_000:
                        yield _rows(out)
                        out = []
                source.close()
                if out:
                    yield _rows(out)

    files_df = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return files_df.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_planes(docs: DataFrame, vocabulary: str | None = None, kind: str = "byte") -> DataFrame:
    """Write all documents as plane files in the shared folder and return what reading them back gives."""
    return read_planes(write_planes(docs, scratch(docs.sparkSession, "planes"), vocabulary, kind))
