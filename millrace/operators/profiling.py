"""Dataset profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank
from .analytics import placed_counts

# Name hints of field roles, metadata first.
METADATA_HINTS = ["id", "lang", "type", "model", "temperature", "tokens", "penalty", "is_selected", "meta"]
QUERY_HINTS = ["query", "question", "q_"]
DOCUMENT_HINTS = ["passage", "document", "doc", "context", "translated_passages", "english_passages"]


def is_missing(df: DataFrame, path: str) -> Column:
    """Null, empty string or empty array."""
    kind = df.select(path).schema.fields[0].dataType
    x = F.col(path)
    if isinstance(kind, T.StringType):
        return x.isNull() | (x == "")
    return x.isNull() | (F.size(x) == 0) if isinstance(kind, T.ArrayType | T.MapType) else x.isNull()


def missing_counts(df: DataFrame, *paths: str) -> DataFrame:
    """One row per path: field, missing."""
    counts = df.agg(*[F.count_if(is_missing(df, p)).alias(f"c{i}") for i, p in enumerate(paths)])
    pairs = F.array(*[F.struct(F.lit(p).alias("field"), F.col(f"c{i}").alias("missing")) for i, p in enumerate(paths)])
    return counts.select(F.inline(pairs))


def length_profile(df: DataFrame, column: str) -> DataFrame:
    """Size, mean, median, least, most and nearest-rank percentiles of lengths (characters or elements; nulls don't count)."""
    kind = df.schema[column].dataType
    size = F.length(column) if isinstance(kind, T.StringType) else F.size(column) if isinstance(kind, T.ArrayType) else F.lit(0)
    sizes = df.filter(F.col(column).isNotNull()).select(F.lit(column).alias("stage"), size.cast("long").alias("ms"))
    placed = placed_counts(sizes).select("stage", F.col("ms").alias("v"), "upto", "n")
    total = sizes.agg(F.count(F.lit(1)).alias("size"), F.sum("ms").alias("s"), F.min("ms").alias("least"), F.max("ms").alias("most"))
    at = lambda p: F.min(F.when(F.col("upto") > F.bround(F.lit(p) * (F.col("n") - 1)), F.col("v")))
    low = F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) / 2), F.col("v")))
    high = F.min(F.when(F.col("upto") > F.ceil((F.col("n") - 1) / 2), F.col("v")))
    found = placed.groupBy("stage").agg(((low + high) / 2).alias("median"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))
    whole = total.join(F.broadcast(found), F.lit(True), "left")  # one row each
    return whole.select("size", F.round(F.col("s") / F.col("size"), 2).alias("mean"), "median", "least", "most", "p50", "p90", "p99")


def sample_profile(df: DataFrame, *fields: str) -> DataFrame:
    """Per field: missing values, and least, most and mean length (characters or elements) of those that aren't null; numbers have no lengths."""
    made = []
    for i, name in enumerate(fields):
        kind = df.select(name).schema.fields[0].dataType
        size = F.length(name) if isinstance(kind, T.StringType) else F.size(name) if isinstance(kind, T.ArrayType) else F.lit(None).cast("int")
        made += [F.count_if(is_missing(df, name)).alias(f"m{i}"), F.min(size).cast("long").alias(f"a{i}"), F.max(size).cast("long").alias(f"b{i}"), F.round(F.avg(size), 4).alias(f"c{i}")]
    pairs = [F.struct(F.lit(name).alias("field"), F.col(f"m{i}").alias("missing"), F.col(f"a{i}").alias("least"), F.col(f"b{i}").alias("most"), F.col(f"c{i}").alias("mean")) for i, name in enumerate(fields)]
    return df.agg(*made).select(F.inline(F.array(*pairs)))


def sample_roles(names: list[str]) -> dict[str, list[str]]:
    """Names that may be those of queries, documents and metadata; a name may be several."""
    has = lambda hints: [n for n in names if any(h in n.lower() for h in hints)]
    return {"query": has(["query"]), "document": has(["passage", "document", "answer"]), "metadata": has(["id", "type", "lang", "meta"])}


def describe(schema: T.StructType, prefix: str = "") -> list[tuple[str, str, bool, int]]:
    """(path, type, nullable, depth) of every field, those of structs and of arrays of structs below theirs."""
    found = []
    for f in schema.fields:
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        found.append((f"{prefix}{f.name}", f.dataType.simpleString(), f.nullable, prefix.count(".")))
        if isinstance(inner, T.StructType):
            found += describe(inner, f"{prefix}{f.name}.")
    return found


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    """Ids seen more than once with their number; nulls don't count."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def split_health(df: DataFrame, query: str, passages: str, *order: str, rows: int = 1000) -> DataFrame:
    """Of the first rows: scanned, blank queries, rows without passages."""
    head = df.orderBy(*order).limit(rows)
    return head.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(is_blank(F.col(query))).alias("blank_queries"), F.count_if(is_missing(df, passages)).alias("no_passages"))


def paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """Dotted leaf paths with their types; arrays of structs are entered."""
    found = []
    for f in schema.fields:
        kind, name = f.dataType, f"{prefix}{f.name}"
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        found += paths(inner, f"{name}.") if isinstance(inner, T.StructType) else [(name, kind.simpleString())]
    return found


def schema_paths(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(paths(schema), "path string, type string")


def field_role(path: Column) -> Column:
    low = F.lower(path)
    has = lambda hints: F.greatest(F.lit(False), *[F.contains(low, F.lit(h)) for h in hints])
    return F.when(has(METADATA_HINTS), "metadata").when(has(QUERY_HINTS), "query").when(has(DOCUMENT_HINTS), "document").otherwise("metadata")
