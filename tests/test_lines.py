"""Lines by offset and batches in file order."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import datasets, lines


def by_offset(path):
    """path's lines as Python finds them."""
    out, at = [], 0
    with open(path, "rb") as f:
        for line in f.read().splitlines(keepends=True):
            out.append((at, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")))
            at += len(line)
    return out


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_offsets_of_all_lines(spark, tmp_path, block):
    rng = random.Random(block)
    for i in range(2):
        text = "".join(rng.choice(["", "a", "é" * rng.randint(1, 9), "x" * rng.randint(0, 40), "last\r"]) + "\n" for _ in range(30)) + ("" if i else "no end")
        (tmp_path / f"f{i}.txt").write_bytes(text.encode())
    got = {}
    for r in lines.lines_with_offsets(spark, f"file://{tmp_path}", block).collect():
        got.setdefault(os.path.basename(r.path), []).append((r.offset, r.line))
    for i in range(2):
        want = [(o, t) for o, t in by_offset(tmp_path / f"f{i}.txt")]
        assert sorted(got[f"f{i}.txt"]) == want


def test_lookup_reads_what_is_asked_for(spark, tmp_path):
    store = lines.ChunkStore(spark, f"file://{tmp_path}/store", "chunk_id string, text string")
    rows = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.repeat(F.lit("text é "), 20).alias("text")).repartition(3)
    index = store.save(rows)
    assert index.count() == 3000
    asked = spark.createDataFrame([(f"c{i}", i) for i in [5, 6, 5, 2999, 99999]], "key string, place long")
    got = store.get(asked).collect()
    assert sorted((r.chunk_id, r.place) for r in got) == [("c2999", 2999), ("c5", 5), ("c5", 5), ("c6", 6)]
    assert sorted((r.chunk_id, r.place, r.text) for r in got) == sorted(map(tuple, rows.join(asked, F.col("chunk_id") == F.col("key")).select("chunk_id", "place", "text").collect()))
    one = index.first().length
    total = sum(os.path.getsize(f"{tmp_path}/store/lines/{n}") for n in os.listdir(f"{tmp_path}/store/lines") if n.endswith("json"))
    for wanted in (1, 10, 100):
        far = index.orderBy("path", "offset").withColumn("n", F.monotonically_increasing_id()).filter(f"n % {3000 // wanted} = 0").select("key")
        read = lines.lookup(far, index).agg(F.sum("read")).first()[0]
        assert read <= max(wanted * one * 2, min(total, wanted * lines.GAP))
    neighbours = index.orderBy("path", "offset").limit(50).select("key")
    told = lines.lookup(neighbours, index).filter("read > 0").collect()
    assert len(told) == 1 and told[0].read >= 50 * (one - 2)


def test_far_lines_are_ranges_of_their_own(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text("".join(f'{{"k": {i}, "t": "{"x" * 500}"}}\n' for i in range(400)))
    index = lines.offset_index(spark, f"file://{tmp_path}/a.json", "k long, t string", "k")
    asked = spark.createDataFrame([(1,), (2,), (390,)], "key long")
    read = {r.key: r.read for r in lines.lookup(asked, index).collect()}
    assert sorted(read) == [1, 2, 390] and sum(read.values()) < 2000 + 4 and read[390] > 500


def test_a_malformed_line_tells_its_offset(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}\n\n{"k": oops}\n')
    with pytest.raises(Exception, match="malformed JSON line at offset 10"):
        datasets.jsonl_chunks(spark, f"file://{tmp_path}/a.json", "k long").collect()
    with pytest.raises(Exception, match="malformed JSON line at offset 10"):
        lines.offset_index(spark, f"file://{tmp_path}/a.json", "k long", "k").collect()


def jobs(spark, run):
    """How many jobs something takes."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_batches_in_file_order(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path, values, rng = tmp_path / "t", [], random.Random(3)
    path.mkdir()
    for i in range(4):
        mine = [(rng.randrange(1000), [j]) for j in range(rng.randint(0, 90))]
        values += mine
        pq.write_table(pa.table({"v": pa.array([a for a, _ in mine], pa.int64()), "nested": pa.array([b for _, b in mine], pa.list_(pa.int64()))}), path / f"part {i}.parquet", row_group_size=7)
    rows = datasets.row_batches(spark, f"file://{path}", 25)
    assert rows.columns == ["v", "nested", "batch"]
    got = {}
    for r in rows.collect():
        got.setdefault(r.batch, []).append((r.v, list(r.nested)))
    want = [values[i : i + 25] for i in range(0, len(values), 25)]
    assert {b: sorted(x) for b, x in got.items()} == {b: sorted(x) for b, x in enumerate(want)}
    for number in (0, len(want) - 1):
        assert sorted((r.v, list(r.nested)) for r in datasets.read_batch(spark, f"file://{path}", number, 25).collect()) == sorted(want[number])
    assert datasets.read_batch(spark, f"file://{path}", 0, 10_000).count() == len(values)
    for bad in (-1, len(want)):
        with pytest.raises(IndexError):
            datasets.read_batch(spark, f"file://{path}", bad, 25)
    for bad in (0, True, 2.5):
        with pytest.raises(ValueError):
            datasets.row_batches(spark, f"file://{path}", bad)
    # however many batches there are, they are one pass
    counted = [jobs(spark, lambda n=n: datasets.row_batches(spark, f"file://{path}", n).groupBy("batch").count().collect()) for n in (1, 100)]
    assert counted[0] == counted[1]
