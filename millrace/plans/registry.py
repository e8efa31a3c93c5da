"""Queries by name, with their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register a function (spark, folder) under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def norm(x: str) -> str:
    """SQL of the text normaliser."""
    return f"trim(regexp_replace(translate(nfc_normalize(coalesce({x}, '')), chr(9) || chr(10) || chr(13), '   '), ' +', ' ', 'g'))"


#: SQL of the passage view: documents with labels as passages, in the order `ord`.
PASSAGES = f"""p AS (SELECT d.doc_id AS ord, sha256('MSMARCO-XI:' || lang || ':' || d.doc_id || ':0') AS document_id, d.doc_id AS query_id, 0 AS passage_index, source AS query, source AS eng_query,
 'en' AS source_lang, lang AS target_lang, {norm("text")} AS translated_passage, {norm("text")} AS english_passage, coalesce(quality, 0) = 1 AS is_selected
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
