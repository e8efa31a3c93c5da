"""The engine's entities as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import document_id
from ..functions.text import normalize
from ..sources.tables import table


def passages(spark: SparkSession, d: str) -> DataFrame:
    """documents with labels as passages; `ord` is their order."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    rows = table(spark, d, "documents").join(labels, F.col("doc_id") == F.col("l_id"), "left")
    rows = rows.withColumn("norm", normalize(F.col("text")))
    null = F.lit(None).cast("string")
    return rows.select(
        F.col("doc_id").alias("ord"),
        document_id(F.col("lang"), F.col("doc_id"), F.lit(0)).alias("document_id"),
        F.col("doc_id").alias("query_id"),
        F.lit(0).alias("passage_index"),
        F.col("source").alias("query"),
        null.alias("query_type"),
        null.alias("answer"),
        F.lit("en").alias("source_lang"),
        F.col("lang").alias("target_lang"),
        F.col("source").alias("eng_query"),
        null.alias("eng_answer"),
        F.col("norm").alias("translated_passage"),
        F.col("norm").alias("english_passage"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("is_selected"),
    )


def records(spark: SparkSession, d: str) -> DataFrame:
    """conversations as nested records: a turn is a passage; every third conversation's second array is one short."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    english = F.when(F.col("conv_id") % 3 == 0, F.slice("t", 1, F.size("t") - 1)).otherwise(F.col("t"))
    flags = F.transform("t", lambda x: F.when(x["role"] == "assistant", F.lit(" True")).otherwise(F.lit("0")))
    return turns.select(
        F.col("conv_id").cast("string").alias("query_id"),
        F.when(F.col("conv_id") % 5 == 0, F.lit("")).otherwise(F.col("t")[0]["text"]).alias("query"),
        F.col("t")[0]["text"].alias("Eng_Query"),
        F.lit("en").alias("source_lang"),
        F.lit("hi").alias("target_lang"),
        F.struct(F.col("t.text").alias("Translated_passages"), F.transform(english, lambda x: x["text"]).alias("English_passages"), flags.alias("is_selected")).alias("passages"),
    )


def store(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as a vector store with positions."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("position"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label")


def queries(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100 as a query, with the benchmark's items as texts, one after the other."""
    text = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    vectors = table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.join(text, F.expr("query_id div 100") == F.col("item_id"), "left").select("query_id", "embedding", F.coalesce("query", F.lit("")).alias("query"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.col("text").alias("chunk_text"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, text) for chunkers."""
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), normalize(F.col("text")).alias("text"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """events as latency samples in order of (ts, event_id)."""
    return table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"), "ts", "event_id")
