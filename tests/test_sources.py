import pytest
from pyspark.sql import functions as F

from millrace.sources import tables
from millrace.sources.vector_store import VectorStore
from millrace.streaming import live


def test_batches(spark):
    rows = spark.range(25)
    assert [r.id for r in tables.batch(rows, 2, "id", size=10).collect()] == list(range(20, 25))
    with pytest.raises(IndexError):
        tables.batch(rows, 3, "id", size=10)
    with pytest.raises(ValueError):
        tables.batch(rows, 0, "id", size=0)


def test_overwrite_guard_and_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb"), (2, None)], "id long, text string")
    tables.write_parquet(rows, f"{tmp_path}/p")
    with pytest.raises(Exception, match="exist"):
        tables.write_parquet(rows, f"{tmp_path}/p")
    tables.write_jsonl(rows, f"{tmp_path}/j")
    assert tables.read_jsonl(spark, f"{tmp_path}/j", rows.schema).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, f"{tmp_path}/bad.jsonl", rows.schema).collect()


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_do_not_depend_on_partitions(spark, parts):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("k")).repartition(parts)
    assert all(r.k == r.position for r in tables.with_positions(rows, "k").collect())


def test_vector_store(spark, tmp_path):
    made = VectorStore(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(f"c{i}", [float(i), 1.0]) for i in range(5)], "chunk_id string, embedding array<float>")
    assert not made.exists()
    made.save(rows, "chunk_id", dimension=2, model="m", chunks=rows.select("chunk_id"))
    assert made.load(2, "m").count() == 5 and made.chunks().count() == 5
    with pytest.raises(FileExistsError):
        made.save(rows, "chunk_id", dimension=2)
    with pytest.raises(ValueError):
        made.load(3)
    with pytest.raises(ValueError):
        made.save(rows, "chunk_id", dimension=3, overwrite=True)
    assert made.manifest()["count"] == 5  # the failed write left the old version in use
    made.append(rows, "chunk_id")
    assert sorted(r.position for r in made.load().collect()) == list(range(10))
    with pytest.raises(ValueError):
        made.delete()
    made.delete(confirm=True)
    assert not made.exists()


def test_streams_give_what_batches_give(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("a", j, j % 3 == 0, float(j)) for j in range(i * 10, i * 10 + 10)], "key string, seq long, ok boolean, ms double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = "key string, seq long, ok boolean, ms double"
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    last = lambda df: df.orderBy(F.desc("batch")).first()
    assert last(live.drain(spark, live.breaker(read(), recovery=None), "b", "update")).in_a_row == 2
    got = last(live.drain(spark, live.latency(read().select(F.col("key").alias("stage"), "ms")), "l", "update"))
    assert (got.n, got.total, got.least, got.most) == (30, 435.0, 0.0, 29.0)
