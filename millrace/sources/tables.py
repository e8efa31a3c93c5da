"""Reading and writing tables: batches, JSON lines, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import scratch, stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def batch(df: DataFrame, number: int, *order: str, size: int = 500) -> DataFrame:
    """Batch `number` of `size` rows in the given order. Raises ValueError for a bad size and IndexError past the end."""
    if isinstance(size, bool) or not isinstance(size, int) or size <= 0:
        raise ValueError(f"batch size has to be a positive integer: {size!r}")
    if number < 0 or number * size >= df.count():
        raise IndexError(f"there is no batch {number}")
    return df.orderBy(*order).offset(number * size).limit(size)


def write_parquet(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Write with snappy and read back; an existing path is an error unless overwrite is set."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a known schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def with_positions(df: DataFrame, *order: str, name: str = "position", start: int = 0) -> DataFrame:
    """df with gapless numbers in the given total order.

    A range shuffle sorts the rows; each part's numbers begin at the rows of the parts before it. The
    sorted parts are stored first, since another run of the same range shuffle may cut elsewhere. Only
    one count per part reaches the driver.
    """
    spark = df.sparkSession
    part = F.spark_partition_id()
    marked = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part.alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    rows = stored(marked, "sorted")
    base, starts = start, []
    for x in rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect():
        starts.append((x["__part"], base))
        base += x["n"]
    at = F.broadcast(spark.createDataFrame(starts, "__part int, __base long"))
    return rows.join(at, "__part").withColumn(name, F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")
