"""Incremental deduplication with a log as state."""

import os
import random

from pyspark.sql import functions as F

from millrace.operators import dedup
from millrace.streaming import live

COLUMNS = ["document_id", "target_lang", "translated_passage", "english_passage", "is_selected", "ord"]
SCHEMA = "document_id string, target_lang string, translated_passage string, english_passage string, is_selected boolean, ord long"


def passages(seed, n, ids=40, texts=30):
    rng = random.Random(seed)
    return [(f"d{rng.randrange(ids)}", "hi", t := f"t{rng.randrange(texts)}", t, rng.random() < 0.3, seed * 1000 + i) for i in range(n)]


def one_by_one(batches):
    """Kept rows per batch, counters, flags: a plain loop over rows in order."""
    ids, flags, kept, counts = set(), {}, [], dict.fromkeys(dedup.COUNTERS, 0)
    for rows in batches:
        mine = []
        for r in sorted(rows, key=lambda r: r[5]):
            counts["processed"] += 1
            if r[0] in ids:
                counts["identity_duplicates"] += 1
            elif r[2] in flags:
                counts["content_duplicates"] += 1
                counts["conflicts"] += flags[r[2]] != r[4]
                flags[r[2]] |= r[4]
            else:
                counts["kept"] += 1
                ids.add(r[0])
                flags[r[2]] = r[4]
                mine.append(r[5])
        kept.append(sorted(mine))
    return kept, counts, flags


def size(path):
    return sum(os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(path) for n in names)


def test_batches_equal_a_plain_loop(spark, tmp_path):
    parts = [passages(i, 60) for i in range(4)]
    want, counts, flags = one_by_one(parts)
    log = dedup.DedupLog(spark, f"file://{tmp_path}/log", buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)
    for i, rows in enumerate(parts):
        assert sorted(r.ord for r in log.process(frame(rows), i).collect()) == want[i]
        assert sorted(r.ord for r in log.process(frame(rows), i).collect()) == want[i]  # run again: counts once
        if i == 1:
            log.compact()
    assert log.statistics() == counts
    assert sorted(r.flag for r in log.contents().collect()) == sorted(flags.values())
    log.compact()
    assert log.process(frame(parts[0]), 9).count() == 0
    assert dedup.DedupLog(spark, f"file://{tmp_path}/log", buckets=4).statistics()["processed"] == 300


def test_a_batch_that_failed_half_way_begins_anew(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame(passages(1, 50), SCHEMA)
    log = dedup.DedupLog(spark, f"file://{tmp_path}/log")
    broken = monkeypatch.context()
    with broken as m:
        m.setattr(dedup, "write_text", lambda *a: 1 / 0)
        try:
            log.process(rows, 0)
        except ZeroDivisionError:
            pass
    assert log.done() == {}
    want, counts, _ = one_by_one([passages(1, 50)])
    assert sorted(r.ord for r in log.process(rows, 0).collect()) == want[0] and log.statistics() == counts


def test_a_batch_writes_as_much_as_it_brings(spark, tmp_path):
    log = dedup.DedupLog(spark, f"file://{tmp_path}/log", buckets=4)
    written = []
    for i in range(6):
        rows = spark.range(i * 2000, (i + 1) * 2000).select(F.concat(F.lit("d"), "id").alias("document_id"), F.lit("hi").alias("target_lang"), F.sha2(F.col("id").cast("string"), 256).alias("translated_passage"), F.lit("e").alias("english_passage"), F.lit(False).alias("is_selected"), F.col("id").alias("ord"))
        assert log.process(rows, i).count() == 2000
        written.append(size(f"{tmp_path}/log/batches/{i}"))
    assert max(written[1:]) < 1.2 * written[0]


def test_filters_hold_every_key_and_few_others():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    table = lambda h: pa.table({"key": [str(x) for x in h], "hash": h, "bucket": pa.array(np.zeros(len(h), dtype=np.int32))})
    ours, others = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 5000)
    built = dedup._filter_of(table(ours))
    assert dedup._maybe_known(table(ours), built).num_rows == 5000
    assert dedup._maybe_known(table(others), built).num_rows < 150
    assert dedup._maybe_known(table(ours), built.slice(0, 0)).num_rows == 0


def test_a_stream_equals_the_batches(spark, tmp_path):
    parts = [passages(i, 50) for i in range(3)]
    for i, rows in enumerate(parts[:2]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    read = lambda: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    log = dedup.DedupLog(spark, f"file://{tmp_path}/log", buckets=3)
    live.dedup_into(read(), log)
    spark.createDataFrame(parts[2], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    out = live.dedup_into(read(), log)
    want, counts, _ = one_by_one(parts)
    got = {}
    for r in out.collect():
        got.setdefault(r.batch, []).append(r.ord)
    assert [sorted(got.get(i, [])) for i in range(3)] == want and log.statistics() == counts
