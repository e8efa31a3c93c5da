"""Nested records to passages: aliases, flags, flattening, rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import document_id
from ..functions.text import is_blank, normalize, normalize_optional, strip


def first_filled(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that exists and isn't null or empty; else the empty string."""
    there = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(""))


def parse_flag(x: Column) -> Column:
    """'0', '1', 'true', 'false' in any case and with blanks around (so booleans and 0/1 too); anything else is false."""
    text = F.lower(strip(x.cast("string")))
    return F.coalesce(F.when(text.isin("1", "true"), True).when(text.isin("0", "false"), False), F.lit(False))


def canonical_records(raw: DataFrame) -> DataFrame:
    """One row per record with the canonical names; `reject` says why a record is malformed (else null)."""
    fields = [f.name.lower() for f in raw.schema["passages"].dataType.fields]
    inner = {n: raw.schema["passages"].dataType.fields[fields.index(n)].name for n in ("translated_passages", "english_passages", "is_selected")}
    rows = raw.select(
        F.expr("try_cast(query_id AS BIGINT)").alias("query_id"),
        first_filled(raw, "Query", "query").alias("query"),
        first_filled(raw, "Eng_Query", "eng_query").alias("eng_query"),
        F.nullif(first_filled(raw, "Answer", "answer"), F.lit("")).alias("answer"),
        F.nullif(first_filled(raw, "Eng_Answer", "eng_answer"), F.lit("")).alias("eng_answer"),
        (F.col("query_type") if "query_type" in raw.columns else F.lit(None).cast("string")).alias("query_type"),
        (F.col("source_lang") if "source_lang" in raw.columns else F.lit("en")).alias("source_lang"),
        (F.col("target_lang") if "target_lang" in raw.columns else F.lit("hi")).alias("target_lang"),
        *[F.col(f"passages.{inner[n]}").alias(n) for n in inner],
    )
    reject = F.when(F.col("query_id").isNull(), "bad_query_id").when(is_blank(F.col("query")) & is_blank(F.col("eng_query")), "blank_queries")
    return rows.withColumn("reject", reject)


def flatten(raw: DataFrame, compose: bool = True, seen: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per aligned passage of well-formed records; arrays count up to the shortest, blank passages and rows that break the passage schema go. seen: applied to all records on their way, to observe them."""
    records = canonical_records(raw)
    ok = (seen(records) if seen else records).filter("reject is null")
    arrays = ["translated_passages", "english_passages", "is_selected"]
    n = F.least(*[F.coalesce(F.size(a), F.lit(0)) for a in arrays])
    zipped = F.slice(F.arrays_zip(*arrays), F.lit(1), F.greatest(n, F.lit(0)))
    rows = ok.withColumn("z", F.when(n > 0, zipped)).select("*", F.posexplode("z").alias("passage_index", "p"))
    rows = rows.filter(~is_blank(F.col("p.translated_passages")) & ~is_blank(F.col("p.english_passages")))
    rows = rows.filter(~is_blank(F.col("query")) & ~is_blank(F.col("eng_query")) & F.length("source_lang").between(2, 10) & F.length("target_lang").between(2, 10))
    return rows.select(
        document_id(F.col("target_lang"), F.col("query_id"), F.col("passage_index")).alias("document_id"),
        "query_id",
        "passage_index",
        normalize(F.col("query"), compose).alias("query"),
        "query_type",
        normalize_optional(F.col("answer"), compose).alias("answer"),
        "source_lang",
        "target_lang",
        normalize(F.col("eng_query"), compose).alias("eng_query"),
        normalize_optional(F.col("eng_answer"), compose).alias("eng_answer"),
        normalize(F.col("p.translated_passages"), compose).alias("translated_passage"),
        normalize(F.col("p.english_passages"), compose).alias("english_passage"),
        parse_flag(F.col("p.is_selected")).alias("is_selected"),
    )
