"""Vector and scoring functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double, summed from the first place on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def rounded(x: Column, places: int) -> Column:
    """x with so many decimals. What is negative and rounds to zero is -0.0, as IEEE rounding gives (F.round goes through decimals, which have one zero)."""
    return F.abs(F.round(x, places)) * F.signum(x)


def is_valid(a: Column, dimension: int) -> Column:
    """Of the right length, with finite numbers only."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(a) == dimension) & ~bad, F.lit(False))


def lexical_score(query_tokens: Column, text_tokens: Column) -> Column:
    """Coverage of the distinct query tokens and their saturated frequency by text length; at most 1."""
    query = F.array_distinct(query_tokens)
    matched = F.array_intersect(query, text_tokens)

    def again(k: int) -> Column:
        """Tokens that are there more than k times."""
        return F.transform(F.array(F.array_sort(text_tokens)), lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + k) == x, F.lit(False))))[0]

    # Of each matched token three at most count: it is there, there again, and once more.
    counts = F.size(matched) + F.size(F.array_intersect(matched, again(1))) + F.size(F.array_intersect(matched, again(2)))
    length = 1.0 + F.log1p(F.size(text_tokens) / 50.0)
    score = 0.7 * (F.size(matched) / F.size(query)) + 0.3 * ((counts / length) / (F.size(query) * 2.0))
    return F.when((F.size(query) == 0) | (F.size(matched) == 0), 0.0).otherwise(F.least(F.lit(1.0), score))


def hybrid_score(similarity: Column, lexical: Column, rank: Column, semantic_weight: float = 0.6, lexical_weight: float = 0.4, k: int = 60) -> Column:
    """Weighted sum of rescaled similarity and lexical score, plus a tenth of the reciprocal rank (rank from 0)."""
    if semantic_weight < 0 or lexical_weight < 0 or semantic_weight + lexical_weight <= 0:
        raise ValueError("weights have to be non-negative with a positive sum")
    total = semantic_weight + lexical_weight
    semantic = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), similarity)) + 1.0) / 2.0
    return semantic * (semantic_weight / total) + lexical * (lexical_weight / total) + 0.1 / (k + rank + 1)
