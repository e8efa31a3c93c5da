"""Deterministic keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the name space of passage ids.
NAMESPACE = "MSMARCO-XI"


def document_id(lang: Column, query_id: Column, passage_index: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(NAMESPACE), lang, query_id.cast("string"), passage_index.cast("string")), 256)


def chunk_id(document: Column, strategy: Column, index: Column) -> Column:
    return F.sha2(F.concat(F.lit("document_id="), document, F.lit(":strategy="), strategy, F.lit(":chunk_index="), index.cast("string")), 256)


def fingerprint(lang: Column, translated: Column, english: Column) -> Column:
    return F.sha2(F.concat(F.lit("lang="), lang, F.lit(":trans="), translated, F.lit(":eng="), english), 256)
