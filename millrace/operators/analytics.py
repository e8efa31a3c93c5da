"""Latency statistics, breaker replay and dashboard arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import broadcast_if_small, stored

LAST = 500
BUDGET_MS = 200.0
FAILURES, RECOVERY_SECONDS = 3, 30.0


def latency_stats(samples: DataFrame) -> DataFrame:
    """Per stage of (stage, ms): count, sum, mean, min, max of all samples."""
    return samples.groupBy("stage").agg(F.count("ms").alias("n"), F.round(F.sum("ms"), 4).alias("total"), F.round(F.avg("ms"), 4).alias("mean"), F.min("ms").alias("least"), F.max("ms").alias("most"))


def latest(samples: DataFrame, *order: str, last: int = LAST) -> DataFrame:
    """The last samples of each stage. Spark cuts each task to `last` rows a stage before it shuffles."""
    newest = Window.partitionBy("stage").orderBy(*[F.desc(c) for c in order])
    return samples.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= last).drop("__n")


def percentiles(samples: DataFrame, shares: list[float], names: list[str]) -> DataFrame:
    """Per stage: percentiles by linear interpolation. Holds the distinct values of a stage; for samples of bounded number, such as latest()."""
    found = samples.groupBy("stage").agg(F.percentile("ms", shares).alias("p"))
    return found.select("stage", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(names)])


def placed_counts(samples: DataFrame) -> DataFrame:
    """(stage, ms, upto, n): distinct values with the number of samples up to them and of all in their stage.

    Values are counted (combined before the shuffle) and dealt in ranges of (stage, ms), so a stage may span
    any number of tasks; a range's first number is the sum of the ranges before it, of one row a range and stage.
    """
    counts = samples.filter("ms IS NOT NULL").groupBy("stage", "ms").agg(F.count(F.lit(1)).alias("c"))
    parts = stored(counts.repartitionByRange("stage", "ms").withColumn("part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("stage", "part").agg(F.sum("c").alias("held"))
    before = Window.partitionBy("stage").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stage")
    base = sums.select("stage", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"), F.sum("held").over(whole).alias("n"))
    inside = Window.partitionBy("stage", "part").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("own", F.sum("c").over(inside)).join(broadcast_if_small(base, "stage"), ["stage", "part"]).select("stage", "ms", (F.col("base") + F.col("own")).alias("upto"), "n")


def _value_at(place: Column) -> Column:
    """The value at a place from 0 in the sorted samples."""
    return F.min(F.when(F.col("upto") > place, F.col("ms")))


def all_percentiles(samples: DataFrame, shares: list[float], names: list[str]) -> DataFrame:
    """Per stage: percentiles by linear interpolation over any number of samples."""
    places = [F.lit(p) * (F.col("n") - 1) for p in shares]
    ends = [x for i, at in enumerate(places) for x in (_value_at(F.floor(at)).alias(f"low{i}"), _value_at(F.ceil(at)).alias(f"high{i}"))]
    found = placed_counts(samples).groupBy("stage", "n").agg(*ends)
    value = lambda i: F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (places[i] - F.floor(places[i]))
    return found.select("stage", *[F.round(value(i), 6).alias(n) for i, n in enumerate(names)])


def index_percentiles(samples: DataFrame) -> DataFrame:
    """Per stage: values at the places n // 2, int(0.9 n) and min(n - 1, int(0.99 n)) of the sorted samples."""
    at = {"p50": F.floor(F.col("n") / 2), "p90": F.floor(F.col("n") * 0.9), "p99": F.least(F.col("n") - 1, F.floor(F.col("n") * 0.99))}
    return placed_counts(samples).groupBy("stage").agg(*[_value_at(place).alias(name) for name, place in at.items()])


def breaker_states(outcomes: DataFrame, failures: int = FAILURES) -> DataFrame:
    """Replay of (key, seq, ok): consecutive failures and the state after each outcome, before any recovery.

    Outcomes are dealt in ranges of (key, seq), so a key's history may span any number of tasks. A range tells how
    many failures it ends with and whether it holds a success; from those, in order, comes what each range begins with.
    """
    if failures < 1:
        raise ValueError("a breaker needs at least one failure")
    parts = stored(outcomes.select("key", "seq", "ok").repartitionByRange("key", "seq").withColumn("part", F.spark_partition_id()), "outcomes")
    order = Window.partitionBy("key", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marked = parts.withColumn("island", F.sum(F.col("ok").cast("int")).over(order))
    inside = Window.partitionBy("key", "part", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("own", F.sum((~F.col("ok")).cast("int")).over(inside))
    ends = counted.groupBy("key", "part").agg(F.max_by("own", "seq").alias("last"), F.max(F.col("ok").cast("int")).alias("held"))
    runs = ends.withColumn("run", F.sum("held").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("ending", F.sum("last").over(Window.partitionBy("key", "run").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    carried = runs.select("key", "part", F.coalesce(F.lag("ending").over(Window.partitionBy("key").orderBy("part")), F.lit(0)).alias("carried"))
    met = counted.join(broadcast_if_small(carried, "key"), ["key", "part"])
    in_a_row = (F.col("own") + F.when(F.col("island") == 0, F.col("carried")).otherwise(0)).cast("long")
    return met.select("key", "seq", "ok", in_a_row.alias("in_a_row"), F.when(in_a_row >= failures, "open").otherwise("closed").alias("state"))


def backoff(attempt: Column, base: float = 0.5, most: float = 8.0) -> Column:
    """Seconds before the next try: the base doubled per attempt, up to the most."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))


def gauge_tone(value: Column, budget: Column) -> Column:
    return F.when(value <= 0, "idle").when(value <= 0.6 * budget, "good").when(value <= budget, "warn").otherwise("hot")


def gauge_width(value: Column, budget: Column) -> Column:
    return F.least(F.lit(100.0), value / budget * 100.0)
