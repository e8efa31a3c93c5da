"""Preprocessing and index building from raw records."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..cluster import stored
from ..sources import datasets
from ..sources.tables import write_parquet
from ..sources.vector_store import VectorStore, file_system
from . import chunking, dedup, ingest, providers, retrieval, validate

# Training and validation files of each language.
LANGUAGE_FILES = {
    "as": ("asmtrain.parquet", "asmval.parquet"),
    "bn": ("bentrain.parquet", "benval.parquet"),
    "gu": ("gujtrain.parquet", "gujval.parquet"),
    "hi": ("hintrain.parquet", "hinval.parquet"),
    "kn": ("kantrain.parquet", "kanval.parquet"),
    "ml": ("maltrain.parquet", "malval.parquet"),
    "mr": ("martrain.parquet", "marval.parquet"),
    "ne": ("neptrain.parquet", "nepval.parquet"),
    "or": ("oritrain.parquet", "orval.parquet"),
    "pa": ("pantrain.parquet", "panval.parquet"),
    "sa": ("santrain.parquet", "sanval.parquet"),
    "ta": ("tamtrain.parquet", "tamval.parquet"),
    "te": ("teltrain.parquet", "telval.parquet"),
    "ur": ("urdtrain.parquet", "urdval.parquet"),
}


COUNTERS = ["input_records", "malformed", "flattened", "duplicates", "invalid", "written"]


@dataclass(frozen=True)
class Preprocessed:
    """passages, stored; counters of the run, and the same as one row."""

    passages: DataFrame
    counters: dict[str, int]

    @property
    def statistics(self) -> DataFrame:
        return self.passages.sparkSession.createDataFrame([tuple(self.counters[c] for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))


def _observed(raw: DataFrame, prefer_selected: bool, compose: bool = True) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """Valid passages, and what tells their counters after the one job that writes them: rows are counted on their way by observations."""
    n = F.count(F.lit(1)).alias("n")
    records, flat, kept = (Observation() for _ in range(3))
    rows = ingest.flatten(raw, compose, lambda df: df.observe(records, n, F.count_if(F.col("reject").isNotNull()).alias("bad")))
    rows = rows.withColumn("ord", F.struct("query_id", "passage_index", "target_lang")).observe(flat, n)
    judged = validate.with_errors(dedup.by_content(dedup.by_identity(rows), prefer_selected)).observe(kept, n, F.count_if("is_valid").alias("good"))

    def counters() -> dict[str, int]:
        seen, flattened, left = records.get, flat.get.get("n", 0), kept.get  # empty where the plan ended early without rows
        found = (seen.get("n", 0), seen.get("bad", 0), flattened, flattened - left.get("n", 0), left.get("n", 0) - left.get("good", 0), left.get("good", 0))
        return dict(zip(COUNTERS, found, strict=True))

    return judged.filter("is_valid").drop("ord", "place", "errors", "is_valid"), counters


def preprocess(raw: DataFrame, prefer_selected: bool = True, compose: bool = True) -> Preprocessed:
    """Flatten, deduplicate and validate, in one job over the input."""
    passages, counters = _observed(raw, prefer_selected, compose)
    return Preprocessed(stored(passages, "passages"), counters())


def dry_run(raw: DataFrame, batches: int = 1, batch_size: int = 500, sample: int = 5) -> tuple[DataFrame, DataFrame]:
    """Statistics and at most `sample` passages of the first batches as the files hold them; nothing is written, and nothing sorted but the passages of these batches."""
    done = preprocess(raw.limit(batches * batch_size))
    return done.statistics, done.passages.orderBy("query_id", "passage_index").limit(min(sample, 5))


#: Columns of written passages with their types, in order.
PASSAGE_SCHEMA = {
    "document_id": "string",
    "query_id": "bigint",
    "passage_index": "int",
    "query": "string",
    "query_type": "string",
    "answer": "string",
    "source_lang": "string",
    "target_lang": "string",
    "eng_query": "string",
    "eng_answer": "string",
    "translated_passage": "string",
    "english_passage": "string",
    "is_selected": "boolean",
}


def write_passages(passages: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Write passages in their fixed schema and read them back. Missing columns and (unless overwrite) an existing path are errors; what a failed write leaves is removed."""
    absent = [c for c in PASSAGE_SCHEMA if c not in passages.columns]
    if absent:
        raise ValueError(f"passages lack {absent}")
    fs, at, _ = file_system(passages.sparkSession, path)
    if fs.exists(at) and not overwrite:
        raise FileExistsError(path)
    shaped = passages.select(*[F.col(c).cast(kind) for c, kind in PASSAGE_SCHEMA.items()])
    try:
        return write_parquet(shaped, path, overwrite)
    except Exception:
        fs.delete(at, True)
        raise


def preprocess_dataset(raw: DataFrame, path: str, overwrite: bool = False, batch_size: int = 500, prefer_selected: bool = True) -> dict[str, int]:
    """Flatten, deduplicate, validate and write in one job, which also counts; counters with the number of batches of raw records."""
    spark = raw.sparkSession
    fs, at, _ = file_system(spark, path)
    if fs.exists(at) and not overwrite:  # before any work
        raise FileExistsError(path)
    passages, counters = _observed(raw, prefer_selected)
    write_passages(passages, path, overwrite)
    found = counters()
    return found | {"batches": -(-found["input_records"] // batch_size)}


def build_index(passages: DataFrame, store: VectorStore, embedder: providers.Embedder, dimension: int, strategy: str = "adaptive", model: str = "hash", engine: chunking.ChunkingEngine | None = None, overwrite: bool = False, append: bool = False) -> dict:
    """Chunk, embed and publish; the manifest with the counts. Each text is embedded once. A vector that isn't its own best match is an error, and the old index stays in use.

    append: behind what the store has, if it has something.
    """
    lineage = passages.select("document_id", "query_id", "passage_index", "target_lang", "source_lang", "is_selected")
    chunks = (engine or chunking.ChunkingEngine()).chunk(passages.select("document_id", F.col("translated_passage").alias("text")), strategy).join(lineage, "document_id")
    chunks = stored(chunks, "chunks")
    vectors = stored(providers.embed(chunks, embedder, dimension, fail_fast=True).select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")), "vectors")
    first = vectors.orderBy("chunk_id").first()
    if first is not None:
        best = retrieval.top_k(vectors.withColumn("position", F.xxhash64("chunk_id")), list(first["embedding"]), 1).first()
        own = sum(float(x) * float(x) for x in first["embedding"])
        if best["score"] > own + 1e-6:
            raise ValueError("the first chunk isn't its own best match")
    if append and store.exists():
        return store.append(vectors, "chunk_id", chunks=chunks)
    return store.save(vectors, "chunk_id", dimension=dimension, model=model, chunks=chunks, overwrite=overwrite)


def _first_of_files(raw: DataFrame, number: int) -> DataFrame:
    """The first rows of a Parquet table in the order of its files."""
    placed = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return placed.orderBy("__file", "__row").limit(number).drop("__file", "__row")


@dataclass
class DatasetIndexer:
    """Index the files of several languages, one after the other, into one store.

    root: folder with the files of LANGUAGE_FILES; base_url: where files that aren't there come from;
    most_samples: raw records a language, in the order of the files; progress: called with a dict after each language, what it raises is ignored.
    """

    spark: SparkSession
    store: VectorStore
    embedder: providers.Embedder
    dimension: int
    root: str | None = None
    base_url: str | None = None
    split: str = "train"
    strategy: str = "adaptive"
    model: str = "hash"
    most_samples: int | None = None
    engine: chunking.ChunkingEngine | None = None

    def run(self, languages: list[str], progress: Callable[[dict], None] | None = None, overwrite: bool = False) -> dict:
        """Counters of the run: per language records, passages and chunks, in all documents, chunks, vectors and vectors a second."""
        unknown = [x for x in languages if x not in LANGUAGE_FILES]
        if unknown or self.split not in ("train", "validation"):
            raise ValueError(f"unknown languages {unknown} or split {self.split!r}")
        if self.store.exists() and not overwrite:
            raise FileExistsError(self.store.root)
        start, done, count = time.perf_counter(), {}, 0
        for number, code in enumerate(languages):
            raw = datasets.raw_records(self.spark, LANGUAGE_FILES[code][0 if self.split == "train" else 1], self.root, self.base_url)
            raw = raw if self.most_samples is None else _first_of_files(raw, self.most_samples)
            if "target_lang" not in raw.columns:
                raw = raw.withColumn("target_lang", F.lit(code))
            made = preprocess(raw)
            manifest = build_index(made.passages, self.store, self.embedder, self.dimension, self.strategy, self.model, self.engine, overwrite=overwrite and number == 0, append=number > 0)
            done[code] = {"records": made.counters["input_records"], "passages": made.counters["written"], "chunks": manifest["count"] - count}
            count = manifest["count"]
            if progress is not None:
                try:
                    progress({"language": code, **done[code], "total": count})
                except Exception:  # noqa: S110 - the callback's own failure doesn't count
                    pass
        documents = self.store.chunks().select("document_id").distinct().count() if count else 0
        seconds = time.perf_counter() - start
        return {"languages": done, "documents": documents, "chunks": count, "vectors": count, "seconds": seconds, "vectors_per_second": count / seconds if seconds else 0.0}
