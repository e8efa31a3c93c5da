"""Operator 8, two-pass external shuffle into shards.

Pass 1 scatters rows into memory-sized buckets by a seeded hash of the row's number and doc_id, so that
neither equal ids nor equal texts meet in one bucket. Pass 2 loads one bucket a task, puts it in the
order of its hashes (what arrives from a shuffle has no order), shuffles it by Fisher-Yates with a
seeded generator and writes it. The buckets one after the other are the shuffled stream; shard s is
its s-th equal slice, so shards differ by one row at most (law `rows`).

A bucket takes its size from the executors' memory. More than MOST_BUCKETS of them are scattered in two
levels, first into groups of buckets and then group by group, so no shuffle has more than that many parts.
The rows of a bucket and their order are the same either way.

Defined cases: a null text has no bytes and stays null; null ids and repeated rows are rows like others;
a very long text is one row, whole, and its bucket larger by it; equal hashes are ordered by doc_id;
with fewer rows than shards some shards are empty; an empty table gives no row; columns other than doc_id
and text aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import broadcast_if_small, scratch, ship
from .memory import enter

LEAST_BUCKET, MOST_BUCKET = 32 << 20, 256 << 20
#: A bucket is held as arrow arrays next to its shuffled copy, beside what other tasks of the executor hold.
MEMORY_SHARE = 64
MOST_BUCKETS = 8192


def bucket_size(spark: SparkSession) -> int:
    """Bytes of a bucket: a share of an executor's memory per core."""
    conf = spark.sparkContext.getConf()
    memory = conf.get("spark.executor.memory", conf.get("spark.driver.memory", "1g")).lower()
    scale = {"k": 10, "m": 20, "g": 30, "t": 40}
    digits, unit = memory.rstrip("kmgtb"), memory.rstrip("b")[-1]
    size = int(digits) << scale.get(unit, 0)
    cores = spark.sparkContext.defaultParallelism if spark.sparkContext.master.startswith("local") else int(conf.get("spark.executor.cores", "1"))
    return min(MOST_BUCKET, max(LEAST_BUCKET, size // cores // MEMORY_SHARE))


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation: for i from the last down, swap i with one of 0 to i. The draws are made at once."""
    order = list(range(n))
    draws = rng.integers(0, np.arange(n, 0, -1)).tolist() if n else []
    for i, j in zip(range(n - 1, -1, -1), draws, strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shuffled_buckets(docs: DataFrame, seed: int = 7, bucket_bytes: int | None = None) -> DataFrame:
    """Both passes over (doc_id, text): the written rows as bucket, place, doc_id, text."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select("doc_id", "text")
    total = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // (bucket_bytes or bucket_size(spark))))
    key = F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), F.col("doc_id"))
    dealt = own.withColumn("key", key).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("key")), F.lit(buckets)).cast("int"))

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("sharding")
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("key", "ascending"), ("doc_id", "ascending")])
        order = fisher_yates(rows.num_rows, np.random.default_rng([seed, rows.column("bucket")[0].as_py()]))
        for i in range(0, len(order), 2000):
            part = rows.take(pa.array(order[i : i + 2000]))
            place = pa.array(np.arange(i, i + part.num_rows))
            whole = pa.Table.from_arrays([part.column("bucket"), place, part.column("doc_id"), part.column("text")], ["bucket", "place", "doc_id", "text"])
            yield from whole.combine_chunks().to_batches()

    path = scratch(spark, "shuffled")
    schema = f"bucket int, place long, doc_id {own.schema['doc_id'].dataType.simpleString()}, text string"
    if buckets <= MOST_BUCKETS:
        dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(shuffle, schema).write.parquet(path)
        return spark.read.schema(schema).parquet(path)
    each = math.isqrt(buckets - 1) + 1
    groups, first = -(-buckets // each), scratch(spark, "groups")
    grouped = dealt.withColumn("group", F.expr(f"cast(bucket div {each} as int)"))
    grouped.repartitionById(groups, F.col("group")).write.partitionBy("group").parquet(first)
    whole = spark.read.schema(grouped.schema).parquet(first)
    for g in range(groups):  # each a shuffle of its own
        own = whole.filter(F.col("group") == g).drop("group")
        own.repartitionById(each, F.col("bucket") - g * each).mapInArrow(shuffle, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def shard(docs: DataFrame, shards: int = 16, seed: int = 7, bucket_bytes: int | None = None) -> DataFrame:
    """All documents in shuffled shards: doc_id, text, shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    rows = shuffled_buckets(docs, seed, bucket_bytes)
    base, starts = 0, []
    for x in rows.groupBy("bucket").count().orderBy("bucket").collect():  # one row per bucket of bucket_bytes
        starts.append((x["bucket"], base))
        base += x["count"]
    at = broadcast_if_small(spark.createDataFrame(starts, "bucket int, base long"), row_bytes=32)
    place = F.col("base") + F.col("place")
    n = max(base, 1)
    return (
        rows.join(at, "bucket")
        .select("doc_id", "text", place.alias("at"), F.expr(f"cast((base + place) * {shards} div {n} as int)").alias("shard"))
        .select("doc_id", "text", "shard", (F.col("at") - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")).alias("slot"))
    )
