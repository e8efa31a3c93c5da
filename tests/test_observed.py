"""Counters by observation, progress of streams, chunkers as table functions."""

import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import build, chunking
from millrace.streaming import live

SCHEMA = "query_id string, query string, Eng_Query string, source_lang string, target_lang string, passages struct<Translated_passages: array<string>, English_passages: array<string>, is_selected: array<string>>"
ROWS = [(str(i), "q", "e", "en", "hi", ([f"पाठ {i}", "same", "  "], [f"text {i}", "same", "x"], ["1", "0", "1"])) for i in range(4)] + [("x", "q", "e", "en", "hi", (["a"], ["b"], ["1"])), ("9", "q", "e", "en", "hi", None)]
WANT = {"input_records": 6, "malformed": 1, "flattened": 8, "duplicates": 3, "invalid": 0, "written": 5}


def test_preprocessing_flattens_once(spark, tmp_path):
    """Counted where rows pass: a user function in the input's plan runs once a record."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    raw = spark.createDataFrame(ROWS, SCHEMA)
    marked = raw.withColumn("query", counted.asNondeterministic()("query"))
    assert build.preprocess(marked).counters == WANT and seen.value == 6
    done = build.preprocess_dataset(marked, f"file://{tmp_path}/p", batch_size=4)
    assert done == WANT | {"batches": 2} and seen.value == 12
    assert spark.read.parquet(f"file://{tmp_path}/p").count() == 5
    assert build.preprocess(raw).statistics.first().asDict() == WANT


def test_counters_of_nothing(spark):
    assert build.preprocess(spark.createDataFrame([], SCHEMA)).counters == dict.fromkeys(WANT, 0)
    assert build.preprocess(spark.createDataFrame(ROWS[4:5], SCHEMA)).counters == dict.fromkeys(WANT, 0) | {"input_records": 1, "malformed": 1}


def test_progress_of_a_stream(spark, tmp_path):
    told = []
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    listener = live.report_progress(spark, told.append)
    try:
        read = spark.readStream.schema("id long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        live.drain(spark, read.observe("facts", F.count(F.lit(1)).alias("n"), F.max("id").alias("most")), "told")
        until = time.time() + 30
        while len([x for x in told if x["rows"]]) < 2 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sorted((x["rows"], x["observed"]["facts"]["most"]) for x in told if x["rows"]) == [(5, 4), (10, 9)]


def test_a_chunker_in_sql_is_that_of_the_engine(spark):
    engine = chunking.ChunkingEngine()
    chunking.register_chunker(spark, engine, "lines", lambda text: text.split("\n"))
    docs = spark.createDataFrame([("a", "one\ntwo\n \nthree", 1), ("b", "", 2), ("c", None, 3), ("d", "é\nlast", 4)], "document_id string, text string, other int")
    docs.createOrReplaceTempView("chunked_docs")
    want = sorted(map(str, engine.chunk(docs, "lines").collect()))
    assert len(want) == 5
    assert sorted(map(str, spark.sql(f"SELECT {', '.join('c.' + x for x in chunking.COLUMNS)} FROM chunked_docs d, LATERAL lines_chunks(d.document_id, d.text) c").collect())) == want
    assert sorted(map(str, spark.sql("SELECT * FROM lines_chunks(TABLE(chunked_docs) PARTITION BY document_id)").collect())) == want
    with pytest.raises(Exception, match="lacks"):
        spark.sql("SELECT * FROM lines_chunks(TABLE(SELECT 1 AS x))").collect()
    with pytest.raises(Exception, match="takes a table"):
        spark.sql("SELECT * FROM lines_chunks('x')").collect()
