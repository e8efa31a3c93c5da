"""Connected components by alternating large and small stars, with each round written to the shared folder; and totals of keys, however hot."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import BROADCAST_LIMIT, stored

LEAST_SALTS = 16
#: Bytes taken for a row of totals (a key, a salt, aggregates) where their number decides on a broadcast.
TOTAL_BYTES = 160


def with_totals(rows: DataFrame, key: str, spread: str, number: int, **totals: tuple[Column, Column]) -> DataFrame:
    """rows (of this number) with an aggregate per key, without ever bringing a key's rows together.

    totals: name to (aggregate of the rows, aggregate of those partial ones, with `name` as their column).
    Totals of few rows are broadcast. Else rows are dealt by key and a salt, a hash of the column
    spread; partial aggregates per salt meet by key and go back to the salted rows. With the root of
    `number` as the number of salts, no task gets more than about that many rows of one key.
    """
    if is_small(number):
        whole = rows.groupBy(F.col(key).alias("__key")).agg(*[part.alias(name) for name, (part, _) in totals.items()])
        return rows.join(F.broadcast(whole), F.col(key) == F.col("__key")).drop("__key")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(max(LEAST_SALTS, math.isqrt(number)))))
    parts = salted.groupBy(key, "__salt").agg(*[part.alias(name) for name, (part, _) in totals.items()])
    meet = Window.partitionBy(key)
    whole = parts.select(F.col(key).alias("__key"), F.col("__salt").alias("__own"), *[total.over(meet).alias(name) for name, (_, total) in totals.items()])
    return salted.join(whole, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__own"))).drop("__salt", "__key", "__own")


def _least(pairs: DataFrame, number: int) -> DataFrame:
    """(u, v, m): m is the least of u and its partners."""
    return with_totals(pairs, "u", "v", number, w=(F.min("v"), F.min("w"))).select("u", "v", F.least("u", "w").alias("m"))


def _large(edges: DataFrame, number: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _least(both, number).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame, number: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    met = _least(down, number)
    return met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(met.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def is_small(number: int) -> bool:
    """Whether totals of so many rows may be broadcast."""
    return number * TOTAL_BYTES < BROADCAST_LIMIT


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the component's least node. Nodes of any ordered type, without nulls."""
    return sized_components(edges)[0]


def sized_components(edges: DataFrame) -> tuple[DataFrame, int]:
    """components(edges) and the most rows it can have.

    Rounds go on until one changes nothing; their number grows with the logarithm of the longest path.
    """
    now = stored(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, number = state, 2 * state[0]
        large = _large(now, number)
        now = stored(_small(large if is_small(number) else stored(large, "large-stars"), number), "stars")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return nodes, 2 * state[0]
