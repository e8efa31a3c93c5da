"""Dataset folders: listing, splits, languages, inspection of files, records by language, query sets, JSON lines by offset."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files
from ..cluster import broadcast_if_small, scratch, ship, stored
from . import lines
from .tables import batch, with_positions
from .vector_store import file_system

TRAIN, VALIDATION = "train", "validation"


def list_files(spark: SparkSession, root: str) -> list[str]:
    """Paths of all files below a folder, relative to it, in order."""
    fs, at, _ = file_system(spark, root)
    if not fs.exists(at):
        raise FileNotFoundError(root)
    home, found, it = fs.makeQualified(at).toString().rstrip("/"), [], fs.listFiles(at, True)
    while it.hasNext():
        found.append(it.next().getPath().toString()[len(home) + 1 :])
    return sorted(found)


@dataclass(frozen=True)
class Repository:
    files: list[str]
    train: list[str]
    validation: list[str]
    languages: list[str]


def classify(paths: list[str]) -> Repository:
    """Parquet files by split, from the words train and val in the name of the file or of the folder it begins with, and the languages that their names begin with."""
    by_split: dict[str, list[str]] = {TRAIN: [], VALIDATION: []}
    languages: set[str] = set()
    for path in paths:
        folder, name = path.split("/")[0].lower(), path.split("/")[-1]
        if not name.endswith(".parquet"):
            continue
        split = TRAIN if "train" in folder or "train" in name.lower() else VALIDATION if VALIDATION in folder or "val" in name.lower() else None
        if split is None:
            continue
        by_split[split].append(path)
        language = name.split("-")[0] if "-" in name else name.split(".")[0]
        if language not in (TRAIN, VALIDATION, "val"):
            languages.add(language)
    return Repository(paths, by_split[TRAIN], by_split[VALIDATION], sorted(languages))


def list_repository(spark: SparkSession, root: str) -> Repository:
    return classify(list_files(spark, root))


def list_splits(spark: SparkSession, root: str) -> list[str]:
    """Splits that have files."""
    found = list_repository(spark, root)
    return [name for name, paths in ((TRAIN, found.train), (VALIDATION, found.validation)) if paths]


def load_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    found = list_repository(spark, root)
    paths = {TRAIN: found.train, VALIDATION: found.validation}.get(split)
    if not paths:
        raise ValueError(f"there is no split {split!r} in {root}; there are {list_splits(spark, root)}")
    return spark.read.parquet(*[f"{root.rstrip('/')}/{p}" for p in paths])


def fetch(spark: SparkSession, url: str, timeout: float = 60.0) -> str:
    """A web file copied to the shared folder, for readers that need to seek; its new path."""
    path = f"{scratch(spark, 'fetched')}/{urlparse(url).path.rsplit('/', 1)[-1] or 'file'}"
    fs, at, _ = file_system(spark, path)
    out = fs.create(at, False)
    with urllib.request.urlopen(url, timeout=timeout) as source:  # noqa: S310
        while piece := source.read(1 << 20):
            out.write(bytearray(piece))
    out.close()
    return path


def open_parquet(spark: SparkSession, path: str, folders: bool = True) -> DataFrame:
    """A Parquet file or table; from the web, too. A missing path raises FileNotFoundError, a folder IsADirectoryError unless folders are wanted."""
    if urlparse(path).scheme in ("http", "https"):
        path = fetch(spark, path)
    fs, at, _ = file_system(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if not folders and fs.getFileStatus(at).isDirectory():
        raise IsADirectoryError(path)
    return spark.read.parquet(path)


def batches(df: DataFrame, *order: str, size: int = 500) -> Iterator[DataFrame]:
    """The rows in batches of exactly `size`, the last one shorter. They are sorted and stored once; a batch reads its own rows only."""
    _check_size(size)
    placed = with_positions(df, *order, name="__at")
    for start in range(0, placed.count(), size):
        yield placed.filter((F.col("__at") >= start) & (F.col("__at") < start + size)).drop("__at")


def _in_file_order(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a Parquet table with `__file` and `__row`, the row's number within its file; and (path, rows, __file, base), where each file begins in the order of paths, from footers."""
    named = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", F.col("_metadata.file_path").alias("__file"))
    facts = file_metadata(spark, path).select("path", "rows").join(named, "path")
    counts = with_positions(facts, "__file", name="__number")
    before = Window.orderBy("__number").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    bases = stored(counts.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("__number"), "files")
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return rows, bases


def row_batches(spark: SparkSession, path: str, size: int = 500) -> DataFrame:
    """A Parquet table with `batch`: its rows in the order of its files, in batches of exactly `size`, the last one shorter.

    Footers tell where each file begins, and the reader numbers a file's rows, so nothing is sorted or copied and all batches are one pass.
    """
    _check_size(size)
    rows, bases = _in_file_order(spark, path)
    return rows.join(broadcast_if_small(bases.select("__file", "base"), "__file"), "__file").withColumn("batch", F.expr(f"(base + __row) div {size}")).drop("__file", "__row", "base")


def read_batch(spark: SparkSession, path: str, number: int, size: int = 500) -> DataFrame:
    """One batch of row_batches(), read from those files only that hold its rows. An IndexError past the end."""
    _check_size(size)
    _, bases = _in_file_order(spark, path)
    start, end = number * size, (number + 1) * size
    held = bases.filter((F.col("base") < end) & (F.col("base") + F.col("rows") > start)).orderBy("base").collect()  # the files of one batch
    if number < 0 or not held:
        raise IndexError(f"there is no batch {number}")
    whole, schema = None, spark.read.parquet(path).schema
    for f in held:
        one = spark.read.schema(schema).parquet(f["path"]).filter(F.col("_metadata.row_index").between(max(0, start - f["base"]), end - f["base"] - 1))
        whole = one if whole is None else whole.unionAll(one)
    return whole


def _check_size(size: int) -> None:
    if isinstance(size, bool) or not isinstance(size, int) or size <= 0:
        raise ValueError(f"batch size has to be a positive integer: {size!r}")


def file_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(path, rows, row_groups, columns) of each Parquet file of a table, from footers, read on the executors."""
    ship(spark)
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path")

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in found:
            out = []
            for path in rows.column("path").to_pylist():
                with files.read(path) as f:
                    facts = pq.read_metadata(f)
                out.append((path, facts.num_rows, facts.num_row_groups, facts.schema.names))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["path", "rows", "row_groups", "columns"])

    return paths.mapInArrow(read, "path string, rows long, row_groups long, columns array<string>")


def inspect_file(spark: SparkSession, path: str, sample: int = 20) -> dict:
    """Schema, rows and first rows of a Parquet file; what goes wrong is told in `error`, not raised."""
    try:
        rows = open_parquet(spark, path)
        head = [r.asDict(recursive=True) for r in rows.limit(sample).collect()]
        return {"path": path, "error": None, "schema": {f.name: f.dataType.simpleString() for f in rows.schema.fields}, "rows": rows.count(), "sample": head}
    except Exception as e:
        return {"path": path, "error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", "schema": None, "rows": None, "sample": []}


def raw_records(spark: SparkSession, file: str, local_root: str | None = None, base_url: str | None = None) -> DataFrame:
    """Raw records of a file: below the local root if it is there, else from the web."""
    if local_root is not None:
        path = f"{local_root.rstrip('/')}/{file}"
        fs, at, _ = file_system(spark, path)
        if fs.exists(at):
            return spark.read.parquet(path)
    if base_url is None:
        raise FileNotFoundError(file)
    return open_parquet(spark, f"{base_url.rstrip('/')}/{file}")


QUERY_SET = "id long, lang string, category string, query string"


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """A query set: a JSON array of objects with id, lang, category, query."""
    return spark.read.schema(QUERY_SET).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def jsonl_chunks(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a schema with their `offset`; a malformed line is an error that tells its offset."""
    return lines.parsed(lines.lines_with_offsets(spark, path), schema, "offset")


__all__ = ["batch", "batches", "classify", "fetch", "file_metadata", "inspect_file", "jsonl_chunks", "list_files", "list_repository", "list_splits", "load_split", "open_parquet", "raw_records", "read_batch", "read_queries", "row_batches"]
