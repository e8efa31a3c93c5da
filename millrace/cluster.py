"""What operators need from the cluster: shared scratch folders, the package on every worker, size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while its measured size stays below this many bytes.
BROADCAST_LIMIT = 24 << 20

#: Bytes of an Arrow batch: the setting, its default, and what it becomes. Both JVM and Python hold several batches a task.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b")

_shipped: set[str] = set()
_made: list[str] = []


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the Python workers once per application, and keep Arrow batches small unless the session says otherwise.

    Every function that makes a Python worker run code of this package calls it, so nothing has to be installed there.
    """
    spark = spark or SparkSession.active()
    sc = spark.sparkContext
    if spark.conf.get(BATCH_BYTES[0]) == BATCH_BYTES[1]:
        spark.conf.set(BATCH_BYTES[0], BATCH_BYTES[2])
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share. Where it is unset, a temporary folder serves on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clean() -> None:
    """Remove the scratch tables of this process; called at its end. Tables in other stores than files are left to the store's own rules."""
    for path in _made:
        if urlparse(path).scheme in ("", "file"):
            shutil.rmtree(urlparse(path).path, ignore_errors=True)
    _made.clear()


atexit.register(clean)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, *texts: str, row_bytes: int = 64, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df with a broadcast hint if its rows * row_bytes and the measured bytes of its columns `texts` stay below limit, else df as it is (Spark then shuffles).

    row_bytes bounds the columns of fixed size; df should be cheap to scan, a stored table or a short one.
    """
    if not texts:
        return F.broadcast(df) if df.count() * row_bytes < limit else df
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(f"b{i}") for i, c in enumerate(texts)]).first()
    return F.broadcast(df) if row["n"] * row_bytes + sum(row[f"b{i}"] for i in range(len(texts))) < limit else df
