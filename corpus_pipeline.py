"""The corpus pipeline: clean, deduplicate, decontaminate and pack `documents`, one operator a stage.

Every stage but the last returns the columns of documents, whatever further ones there are, also such whose
names the operators use themselves. Null texts count as empty ones; rows without a doc_id are kept
unless a stage's rule speaks against their text; texts of any length are read whole. An empty table goes
through all stages and gives no row. doc_id is a whole number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import ngram_join, packing, substrings, templates, toxicity
from millrace.cluster import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from this stage's own input.

    Rows that repeat an id or a text are judged alike. An id with several labels is toxic if one says so; without
    labels of both kinds nothing is called toxic unless most labels are. Empty and null texts stay.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies (five-word windows, Jaccard 0.8).

    First is the least doc_id, of equal ones the least digest of the text, nulls last; of rows that repeat both id and text
    one stays. Null and empty texts are copies of each other, so one of them stays.
    """
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has, n_chars counted anew.

    Earlier is a smaller doc_id. Rows without an id, and those whose id stands for another text, stay as they are;
    a document left without a word goes, but one that had none before stays.
    """
    return substrings.without_passages(docs, substrings.repeated_passages(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Rows with equal texts go or stay together; with an empty benchmark all stay."""
    return templates.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents by training sequence. A null or empty text is its end id alone; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("substring_dedup", cut_repeats), ("decontamination", drop_leaks), ("packing", pack)]

#: Decoding, chaining and tokenizing can't be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
