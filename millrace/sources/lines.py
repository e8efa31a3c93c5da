"""Text files by byte offset: every line with where it begins, an index of keys, and reading of single lines by ranges.

Files are cut into blocks; a task reads its block, and the rest of a line that goes on behind it. A lookup joins the requested keys with
the index, and sorts what it finds by file and offset; lines close to each other are read as one range, and nothing else of
the files is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files
from ..cluster import broadcast_if_small, ship

#: Bytes that a task reads at once; how far lines of one range may be apart, and how long a range may be.
BLOCK, GAP, RANGE = 32 << 20, 64 << 10, 8 << 20
BATCH_BYTES = 4 << 20
LINES = "path string, offset long, length long, line string"


def _flushed(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)


def _lines_of_block(path: str, start: int, end: int) -> Iterator[tuple[str, int, int, str]]:
    """Lines that begin in [start, end) of a file."""
    with files.read(path) as f:
        f.seek(max(0, start - 1))
        rest, at = b"", max(0, start - 1)
        skipping = start > 0  # the line that goes on from the block before, up to its end
        while True:
            piece = f.read(min(1 << 20, max(end - at - len(rest), 64 << 10)))
            whole = rest + piece
            begin = 0
            while (stop := whole.find(b"\n", begin)) >= 0:
                if not skipping:
                    if at + begin >= end:
                        return
                    line = whole[begin:stop]
                    yield path, at + begin, stop - begin, line.removesuffix(b"\r").decode("utf-8", "replace")
                skipping, begin = False, stop + 1
            if skipping:
                begin = len(whole)
            rest, at = whole[begin:], at + begin
            if not piece:
                if rest and not skipping and at < end:
                    yield path, at, len(rest), rest.removesuffix(b"\r").decode("utf-8", "replace")
                return
            if not skipping and at >= end:
                return


def lines_with_offsets(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(path, offset, length, line) of the text files at a path, with the byte each line begins at and its bytes; files are split among tasks."""
    ship(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    starts = found.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("start"))
    blocks = starts.select("path", "start", F.least(F.col("start") + block, "size").alias("end")).repartition("path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (line for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True) for line in _lines_of_block(*x))
        yield from _flushed(rows, ["path", "offset", "length", "line"])

    return blocks.mapInArrow(read, LINES)


def parsed(lines: DataFrame, schema: T.StructType | str, *kept: str) -> DataFrame:
    """JSON lines (path, offset, line) as columns of a schema, behind the columns `kept`; blank lines go, a malformed one is an error that tells its offset."""
    whole = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*whole.fields, T.StructField("__bad", T.StringType())])
    json = F.from_json("line", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    bad: Column = F.raise_error(F.concat(F.lit("malformed JSON line at offset "), F.col("offset").cast("string"), F.lit(" of "), F.col("path")))
    rows = lines.filter(F.trim("line") != "").select("path", "offset", *[c for c in kept if c not in ("path", "offset")], json.alias("__j"))
    rows = rows.withColumn("offset", F.when(F.col("__j.__bad").isNull(), F.col("offset")).otherwise(bad.cast("long")))
    return rows.select(*kept, *[F.col(f"__j.{f.name}").alias(f.name) for f in whole.fields])


def offset_index(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """(key, path, offset, length) of the JSON lines at a path: where to find each key. Store it beside the lines."""
    lines = lines_with_offsets(spark, path)
    return parsed(lines, schema, "path", "offset", "length").select(F.col(key).alias("key"), "path", "offset", "length")


def _ranges(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (path, offset, length, ...), sorted, in groups that are read as one range."""
    group, last = [], 0
    for row in rows:
        path, offset, length = row[:3]
        if group and (path != group[0][0] or offset - last > GAP or offset + length - group[0][1] > RANGE):
            yield group
            group, last = [], 0
        group.append(row)
        last = max(last, offset + length)
    if group:
        yield group


def lookup(asked: DataFrame, index: DataFrame) -> DataFrame:
    """asked (key, ...) with path, offset, length, read, line of each line that has its key; keys without one are left out. read: the bytes of a range, told in its first row.

    Requests of a file are dealt by file and place, so a file that many ask for is read by many tasks, each its part.
    """
    ship(index.sparkSession)
    extra = [c for c in asked.columns if c != "key"]
    met = index.join(broadcast_if_small(asked, *[c for c, t in asked.dtypes if t == "string"], row_bytes=64 * len(asked.columns)), "key")
    dealt = met.repartition("path", F.expr(f"offset div {RANGE}")).sortWithinPartitions("path", "offset").select("path", "offset", "length", "key", *extra)
    kinds = dict(dealt.dtypes)
    names = ["path", "offset", "length", "key", *extra, "read", "line"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            opened, f = None, None
            for group in _ranges(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)):
                path, first = group[0][0], group[0][1]
                size = max(o + n for _, o, n, *_ in group) - first
                if path != opened:
                    if f:
                        f.close()
                    opened, f = path, files.read(path)
                f.seek(first)
                whole = f.read(size)
                for i, (_, offset, length, *more) in enumerate(group):
                    line = whole[offset - first : offset - first + length]
                    yield path, offset, length, *more, size if i == 0 else 0, line.removesuffix(b"\r").decode("utf-8", "replace")
            if f:
                f.close()

        yield from _flushed(rows(), names)

    return dealt.mapInArrow(read, ", ".join([*[f"`{n}` {kinds[n]}" for n in names[:-2]], "read long", "line string"]))


class ChunkStore:
    """Chunks as JSON lines with an index of their offsets, both below a root: written once, read by id without a scan of the lines."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, key: str = "chunk_id"):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key

    def save(self, chunks: DataFrame) -> DataFrame:
        """Write lines, then the index; returns the index."""
        chunks.write.json(f"{self.root}/lines")
        offset_index(self.spark, f"{self.root}/lines", self.schema, self.key).write.parquet(f"{self.root}/index")
        return self.index()

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/index")

    def get(self, asked: DataFrame) -> DataFrame:
        """asked (key, ...) with the columns of the chunks that have these keys."""
        extra = [c for c in asked.columns if c != "key"]
        return parsed(lookup(asked, self.index()), self.schema, *extra)
