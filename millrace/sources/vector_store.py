"""Parquet-backed vector store: versions below a root, each with a manifest, and numbered pointers to the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import is_valid
from .tables import with_positions

VERSION, BACKEND = 2, "parquet"


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file, written aside and then renamed: it is there whole or not at all. An existing one is an error."""
    fs, at, jvm = file_system(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at) or not fs.rename(aside, at):
        fs.delete(aside, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def create_store(spark: SparkSession, root: str, backend: str = BACKEND) -> VectorStore:
    if backend != BACKEND:
        raise ValueError(f"unknown backend {backend!r}; there is {BACKEND!r}")
    return VectorStore(spark, root)


class VectorStore:
    """root/versions/<id>/{vectors, chunks, manifest.json} and root/pointers/<n>.json; the one with the highest number names the version in use.

    A version is written whole before a pointer to it appears, by a rename, so readers see the old or the
    new one, and a failed write changes nothing. The manifest lists the folders of a version's vectors
    and chunks; an append writes new ones beside those of the versions before.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> list[int]:
        fs, at, _ = file_system(self.spark, f"{self.root}/pointers")
        if not fs.exists(at):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def exists(self) -> bool:
        """Whether there is a version in use, with its manifest and vectors."""
        if not self._pointers():
            return False
        fs, at, jvm = file_system(self.spark, f"{self._home()}/manifest.json")
        return fs.exists(at) and all(fs.exists(jvm.org.apache.hadoop.fs.Path(p)) for p in self.manifest()["vectors"])

    def save(self, vectors: DataFrame, *order: str, dimension: int, model: str = "unknown", chunks: DataFrame | None = None, overwrite: bool = False) -> dict:
        """Store vectors (chunk_id, embedding, ...) with positions from 0 in the given order."""
        if self._pointers() and not overwrite:
            raise FileExistsError(self.root)
        base = {"dimension": dimension, "model": model, "count": 0, "vectors": [], "chunks": []}
        return self._publish(base, with_positions(vectors, *order), chunks)

    def append(self, vectors: DataFrame, *order: str, chunks: DataFrame | None = None, batch: tuple[str, int] | None = None) -> dict:
        """Add vectors, and chunks, behind those that are there; ids may repeat. What is there isn't read. batch: a stream's id and its batch's number, the last of which the manifest keeps."""
        now = self.manifest()
        if batch is not None:
            now["streams"] = now.get("streams", {}) | {batch[0]: batch[1]}
        return self._publish(now, with_positions(vectors, *order, start=now["count"]), chunks)

    def _publish(self, base: dict, placed: DataFrame, chunks: DataFrame | None) -> dict:
        home = f"{self.root}/versions/{uuid.uuid4().hex}"
        try:
            placed.write.parquet(f"{home}/vectors")
            facts = self.check(self.spark.read.parquet(f"{home}/vectors"), base["dimension"])
            if facts["invalid"] or facts["positions"] != facts["n"] or facts["blank_ids"]:
                raise ValueError(f"vectors don't fit the store: {facts}")
            if chunks is not None:
                chunks.write.parquet(f"{home}/chunks")
            more = {"vectors": [*base["vectors"], f"{home}/vectors"], "chunks": base["chunks"] + ([f"{home}/chunks"] if chunks is not None else [])}
            manifest = base | more | {"version": VERSION, "backend": BACKEND, "count": base["count"] + facts["n"]}
            write_text(self.spark, f"{home}/manifest.json", json.dumps(manifest))
            self._point(home)
        except Exception:
            fs, at, _ = file_system(self.spark, home)
            fs.delete(at, True)
            raise
        return manifest

    def _point(self, home: str) -> None:
        """Two writers at once: the second finds its number taken and fails."""
        number = (self._pointers() or [0])[-1] + 1
        write_text(self.spark, f"{self.root}/pointers/{number}.json", json.dumps({"home": home}))

    def _home(self, back: int = 0) -> str:
        numbers = self._pointers()
        if len(numbers) <= back:
            raise FileNotFoundError(f"there is no index at {self.root}")
        return json.loads(read_text(self.spark, f"{self.root}/pointers/{numbers[-1 - back]}.json"))["home"]

    def rollback(self) -> dict:
        """Use the version before the current one again; both stay on disk."""
        self._point(self._home(1))
        return self.manifest()

    def manifest(self) -> dict:
        """The current version's facts, without reading a vector."""
        return json.loads(read_text(self.spark, f"{self._home()}/manifest.json"))

    inspect = manifest

    def appended(self, stream: str, batch: int) -> bool:
        """Whether a stream's batch is part of the current version."""
        return batch <= self.manifest().get("streams", {}).get(stream, -1)

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(*self.manifest()["vectors"])

    def chunks(self) -> DataFrame | None:
        paths = self.manifest()["chunks"]
        return self.spark.read.parquet(*paths) if paths else None

    def validate(self, dimension: int | None = None, model: str | None = None, backend: str | None = None) -> dict:
        """The manifest, checked against what is expected and against the number of stored rows (from Parquet footers), without reading a vector."""
        manifest = self.manifest()
        wanted = {"version": VERSION, "dimension": dimension, "model": model, "backend": backend or BACKEND}
        for name, value in wanted.items():
            if value is not None and manifest[name] != value:
                raise ValueError(f"the store's {name} is {manifest[name]!r}, not {value!r}")
        if (n := self.vectors().count()) != manifest["count"]:
            raise ValueError(f"the store has {n} vectors, its manifest says {manifest['count']}")
        return manifest

    def load(self, dimension: int | None = None, model: str | None = None) -> DataFrame:
        """The vectors, after manifest and rows are checked against each other and what is expected."""
        manifest = self.validate(dimension, model)
        facts = self.check(self.vectors(), manifest["dimension"])
        if facts["invalid"] or facts["positions"] != facts["n"]:
            raise ValueError(f"the store is damaged: {facts}")
        return self.vectors()

    @staticmethod
    def check(vectors: DataFrame, dimension: int) -> dict:
        row = integrity(vectors, dimension).first()
        return row.asDict()

    def delete(self, confirm: bool = False) -> bool:
        """Whether there was something to delete."""
        if not confirm:
            raise ValueError("delete needs confirm=True")
        fs, at, _ = file_system(self.spark, self.root)
        return fs.delete(at, True)


def integrity(vectors: DataFrame, dimension: int) -> DataFrame:
    """One row: n, distinct positions, invalid vectors, blank ids, least and most position."""
    return vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("position").alias("positions"),
        F.count_if(~is_valid(F.col("embedding"), dimension)).alias("invalid"),
        F.count_if(F.col("chunk_id").isNull() | (F.trim("chunk_id") == "")).alias("blank_ids"),
        F.min("position").alias("least"),
        F.max("position").alias("most"),
    )
