"""Streams with state over several micro-batches, against the same computed at once."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.streaming import live


def batches(spark, path, rows, schema, n):
    """rows in n files of several partitions' worth, read one file a micro-batch."""
    size = -(-len(rows) // n)
    for i in range(n):
        part = rows[i * size : (i + 1) * size]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def by_batch(out, key, *values):
    return {(r[key], r["batch"]): tuple(r[v] for v in values) for r in out.collect()}


def test_recent_percentiles_after_each_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("abb"), i, rng.choice([None, rng.uniform(0, 9)])) for i in range(600)]
    schema = "stage string, seq long, ms double"
    out = live.drain(spark, live.recent_percentiles(batches(spark, f"{tmp_path}/in", rows, schema, 4).repartition(3), 50), "r", "update")
    found = by_batch(out, "stage", "n", "p50", "p70", "p100")
    assert len(found) == 8
    rows.sort(key=lambda r: r[1])
    for (stage, batch), got in found.items():
        mine = [ms for s, seq, ms in rows if s == stage and ms is not None and seq < 150 * (batch + 1)][-50:]
        assert got == pytest.approx((len(mine), *np.percentile(mine, [50, 70, 100])))


def test_breaker_after_each_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, i, rng.random() < p) for i in range(400) for k, p in [rng.choice([("a", 0.3), ("b", 0.9), ("c", 0.02)])]]
    schema = "key string, seq long, ok boolean"
    out = live.drain(spark, live.breaker(batches(spark, f"{tmp_path}/in", rows, schema, 5).repartition(3), recovery=None), "b", "update")
    rows.sort(key=lambda r: r[1])
    states = set()
    for (key, batch), (count, state) in by_batch(out, "key", "in_a_row", "state").items():
        n = 0
        for _, _, ok in [r for r in rows if r[0] == key and r[1] < 80 * (batch + 1)]:
            n = 0 if ok else n + 1
        assert (count, state) == (n, "open" if n >= 3 else "closed")
        states.add(state)
    assert states == {"open", "closed"}


def test_tasks_hand_on_only_what_states_need():
    import pandas as pd

    samples = [pd.DataFrame({"stage": ["s"] * 1000, "seq": range(i, i + 1000), "ms": 1.0}) for i in (5000, 0, 9000)]
    (kept,) = live.last_of_task(10)(iter(samples))
    assert sorted(kept["seq"]) == list(range(9990, 10000))
    seq = np.arange(2000)
    frames = [pd.DataFrame({"key": ["k"] * 1000, "seq": seq[i : i + 1000], "ok": seq[i : i + 1000] % 700 == 0}) for i in (1000, 0)]
    (kept,) = live.outcomes_of_task(iter(frames))
    assert kept["seq"].tolist() == list(range(1400, 2000)) and kept["ok"].tolist() == [True] + [False] * 599


def test_the_timer_makes_an_open_breaker_half_open(spark, tmp_path):
    schema, seen = "key string, seq long, ok boolean", []
    spark.createDataFrame([("k", i, False) for i in range(4)] + [("fine", 0, True)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    read = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = live.breaker(read, recovery=2.0).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/marks").foreachBatch(lambda df, _: seen.extend((r.key, r.in_a_row, r.state) for r in df.collect())).trigger(processingTime="1 second").start()

    def wait(row):
        until = time.time() + 90
        while row not in seen and time.time() < until:
            time.sleep(0.3)
        assert row in seen, seen

    try:
        wait(("k", 4, "open"))
        wait(("k", 4, "half_open"))
        spark.createDataFrame([("k", 9, False)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
        wait(("k", 5, "open"))  # the trial failed
        spark.createDataFrame([("k", 10, True)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
        wait(("k", 0, "closed"))
    finally:
        query.stop()
    assert ("fine", 0, "half_open") not in seen


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    at = lambda minute: f"2024-01-01 10:{minute:02d}:00"
    schema = "ts timestamp, event_type string, value double"
    parts = [[(at(5), "a", 1.0), (at(50), "a", 2.0)], [(at(45), "a", 3.0), (at(1), "a", 4.0)], [(at(58), "a", 5.0), (at(12), "b", 6.0)], [("2024-01-01 12:30:00", "a", 7.0)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    out = live.drain(spark, live.tumbling(read(), "15 minutes", "10 minutes"), "late")
    found = {(r.window.start.strftime("%H:%M"), r.event_type): (r.n, r.total) for r in out.collect()}
    # the first batch moves the watermark to 10:40, which rules from the batch after the next on: 10:12 is late there, 10:01 wasn't yet; the window of 12:30 is still open
    assert found == {("10:00", "a"): (2, 5.0), ("10:45", "a"): (3, 10.0)}
