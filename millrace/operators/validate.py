"""Row validation: checks as (error type, field, condition), told per row or counted over all rows in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import document_id
from ..functions.text import is_blank

# Fixed value: control characters that texts may not hold.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def checks() -> list[tuple[str, str, Column]]:
    """All checks of a passage row, in a fixed order; a condition is true, false or (no error) null."""
    c = F.col
    own = document_id(c("target_lang"), c("query_id"), c("passage_index"))
    absent = c("document_id").isNull() | (c("document_id") == "")
    blank_id = ~absent & is_blank(c("document_id"))
    found = [
        ("empty_document_id", "document_id", absent),
        ("whitespace_document_id", "document_id", blank_id),
        ("inconsistent_document_id", "document_id", ~absent & ~blank_id & (c("document_id") != own)),
        ("invalid_query_id_type", "query_id", c("query_id").isNull()),
        ("negative_passage_index", "passage_index", c("passage_index") < 0),
    ]
    for field in ("query", "eng_query", "translated_passage", "english_passage"):
        found += [(f"empty_{field}", field, is_blank(c(field))), ("invalid_control_chars", field, ~is_blank(c(field)) & c(field).rlike(CONTROL))]
    found += [(f"empty_{field}", field, is_blank(c(field))) for field in ("source_lang", "target_lang")]
    found.append(("invalid_is_selected_type", "is_selected", c("is_selected").isNull()))
    for field in ("answer", "eng_answer"):
        blank = c(field).isNotNull() & is_blank(c(field))
        found += [(f"whitespace_{field}", field, blank), ("invalid_control_chars", field, c(field).isNotNull() & ~is_blank(c(field)) & c(field).rlike(CONTROL))]
    found.append(("whitespace_query_type", "query_type", c("query_type").isNotNull() & is_blank(c("query_type"))))
    return found


def errors() -> Column:
    """All errors of a passage row as (error_type, field), in a fixed order."""
    told = [F.when(when, F.struct(F.lit(kind).alias("error_type"), F.lit(field).alias("field"))) for kind, field, when in checks()]
    return F.filter(F.array(*told), lambda e: e.isNotNull())


def with_errors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("errors", errors()).withColumn("is_valid", F.size("errors") == 0)


def valid(rows: DataFrame) -> DataFrame:
    """The rows without an error."""
    wrong = F.lit(False)
    for _, _, when in checks():
        wrong = wrong | F.coalesce(when, F.lit(False))
    return rows.filter(~wrong)


def error_counts(rows: DataFrame) -> DataFrame:
    """error_type and its number over invalid rows, one per error: one aggregation of all checks, without a row per error."""
    kinds = list(dict.fromkeys(kind for kind, _, _ in checks()))
    sums = [sum((F.when(when, 1).otherwise(0) for k, _, when in checks() if k == kind), F.lit(0)) for kind in kinds]
    counts = rows.agg(*[F.sum(x).cast("long").alias(f"c{i}") for i, x in enumerate(sums)])
    pairs = F.array(*[F.struct(F.lit(kind).alias("error_type"), F.col(f"c{i}").alias("n")) for i, kind in enumerate(kinds)])
    return counts.select(F.inline(pairs)).filter("n > 0")


def query_problem(query: Column) -> Column:
    """Why a query can't be asked, or null."""
    return F.when(query.isNull(), "null query").when(is_blank(query), "blank query")
