"""Operator 4, URL filters by hashed host-suffix and path-prefix expressions. DataFrame functions only.

Each URL is expanded into the expressions <last k labels of the host><first n characters of the
path>, for the label counts and path lengths that rules have. Expressions meet rules in an equi-join on
the first 32 bits of their SHA-256; the whole digest confirms a match. The longest matching rule
decides; of rules for the same expression, `block` does. URLs without a match get the default.

Rules beyond a broadcast are joined by shuffle, where Spark splits the rows of a rule that very many pages meet.

Defined cases: a null url or one without `://` has an empty host and path and gets the default verdict;
a path that is empty fits no rule whose path is `/`; repeated rows and null ids each keep their row; very
long urls are judged whole; rules of equal length for one url are one expression, for which `block` wins; an
empty table of pages or rules gives no row, or the default alone; columns other than page_id and url aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import broadcast_if_small

PREFIX_HEX = 8
#: The rules of the query: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """verdict, host, path of literal rules."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    keyed = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").withColumn("rule", F.concat("host", "path"))
    keyed = keyed.withColumn("labels", F.size(F.split("host", "[.]"))).withColumn("chars", F.length("path"))
    shapes = [(x["labels"], x["chars"]) for x in keyed.select("labels", "chars").distinct().collect()]  # label counts times path lengths
    ruled = keyed.select(F.sha2("rule", 256).alias("rule_digest"), F.struct(F.length("rule").alias("size"), (F.col("verdict") == "block").alias("block"), "rule", "verdict").alias("hit"))
    ruled = broadcast_if_small(ruled.withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX)), "hit.rule", row_bytes=192)

    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    split = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", rest.alias("rest")).withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
    split = split.select("row", "page_id", F.translate("raw", UPPER, LOWER).alias("host"), F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), "^[^?#]*", 0).alias("path"))
    expressions = F.array_distinct(F.array(*[F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n)) for k, n in shapes])) if shapes else F.array().cast("array<string>")
    opened = split.select("row", "page_id", "host", "path", F.explode_outer(expressions).alias("expression"))
    opened = opened.select("row", "page_id", "host", "path", F.sha2("expression", 256).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    met = opened.join(ruled, "prefix", "left")
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(F.col("digest") == F.col("rule_digest"), F.col("hit"))).alias("hit"))
    return best.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH rules(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
m AS (SELECT s.*, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, v DESC) AS k
 FROM s LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
