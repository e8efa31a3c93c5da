"""Operator 10, quality rules by cross-document line frequency. DataFrame functions only.

A word is a run of characters other than blank and U+0009 to U+000D; a line is what stands between
line feeds. Lines are normalised (lower case, runs of white space as one blank, trimmed) and hashed.
A line's frequency is the number of distinct documents (doc_ids) of its host (`source`) that hold it. Lines in
more than max(least_docs, share * distinct documents of the host) are boilerplate; a document is
depleted if less than `left` of its word characters stand outside such lines.

Defined cases: a null text is an empty one (no words: base_failed); a null source is a host of its own, apart
from the empty source; a row without an id is a document of its own; rows that repeat an id are one
document where documents are counted, and each keep their row; very long texts are measured whole; a
line at a limit stays (ties aren't above it); an empty table gives no row; columns other than doc_id, text
and source aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import broadcast_if_small, stored

BLANK = r"[\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
WINDOW = 8


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _host() -> Column:
    """The source as a host; its first character tells a null from a name."""
    return F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source")))


def _lines(text: Column) -> Column:
    """Lines that hold a word, as (line, chars): chars are the code points in its words."""
    chars = lambda x: F.length(x) - F.regexp_count(x, F.lit(BLANK))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), chars(x).alias("chars"))), lambda s: s["chars"] > 0)


def _key(line: Column) -> Column:
    """Hash of a normalised line."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, BLANK + "+", " "))))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; hashes: of the windows, in order."""
    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda e, i: F.get(s, i)["x"] == e["x"]
        return F.filter(s, lambda e, i: F.coalesce(same(e, i - 1), F.lit(False)) | F.coalesce(same(e, i + 1), F.lit(False)))

    places = F.sort_array(F.transform(_let(pairs, twice), lambda e: e["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def measures(docs: DataFrame) -> DataFrame:
    """Per row: row (an internal number), doc_id, host, the base measures, and lines as (key, chars) pairs."""
    text = F.coalesce("text", F.lit(""))
    split = (
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _host().alias("host"), text.alias("t"))
        .withColumn("words", F.array_remove(F.split("t", BLANK + "+"), ""))
        .withColumn("keys", F.transform("words", lambda x: F.xxhash64(x)))
        .withColumn("lines", _lines(F.col("t")))
    )
    n = F.size("words")
    # Each word is hashed once and a window from its words' hashes by position: slicing arrays costs several times as much.
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("keys", i + k) for k in range(WINDOW)])))
    return split.withColumn("hashes", hashes).select(
        "row",
        "doc_id",
        "host",
        n.cast("long").alias("n_words"),
        F.aggregate("lines", F.lit(0), lambda n, s: n + s["chars"]).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines.line"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _covered(F.col("hashes"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda s: F.struct(_key(s["line"]).alias("key"), s["chars"].alias("chars"))).alias("keyed"),
    )


def frequent_lines(docs: DataFrame, least_docs: int = 5, share: float = 0.05) -> DataFrame:
    """(host, key, n): lines of more distinct documents than their host's limit. Counts are combined before each shuffle."""
    text = F.coalesce("text", F.lit(""))
    keys = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), _key))
    # A row without an id is a document of its own.
    own = docs.select(_host().alias("host"), "doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("row"), keys.alias("keys"))
    document = F.struct("doc_id", "row")
    lines = own.select("host", "doc_id", "row", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count_distinct(document).alias("n"))
    hosts = own.groupBy("host").agg(F.count_distinct(document).alias("documents"))
    over = F.col("n") > F.greatest(F.lit(float(least_docs)), F.col("documents") * share)
    return lines.filter(F.col("n") > least_docs).join(hosts, "host").filter(over).select("host", "key", "n")


def judge(docs: DataFrame, least_docs: int = 5, share: float = 0.05, left: float = 0.3) -> DataFrame:
    """Per document: the base measures, base_failed, removed_chars and kept."""
    frequent = broadcast_if_small(stored(frequent_lines(docs, least_docs, share).withColumn("frequent", F.lit(True)), "lines"), "host")
    base = ["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    lines = measures(docs).select(*base, "host", F.explode_outer("keyed").alias("line")).select(*base, "host", F.col("line.key").alias("key"), F.col("line.chars").alias("chars"))
    judged = lines.join(frequent, ["host", "key"], "left").groupBy(*base).agg(F.sum(F.when(F.col("frequent"), F.col("chars")).otherwise(0)).cast("long").alias("removed_chars"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = F.col("word_chars") - F.col("removed_chars") < left * F.col("word_chars")
    return judged.select(*base[1:], "removed_chars", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('+' || source, '-') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(8, i - p))::BIGINT AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -100) AS p FROM dup) GROUP BY r),
ln AS (SELECT r, host, doc, x FROM (SELECT r, host, coalesce('i' || doc_id, 'r' || r) AS doc, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
k AS (SELECT r, host, doc, x, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS key, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM ln),
dl AS (SELECT r, (count(*) - count(DISTINCT x))::BIGINT AS n FROM ln GROUP BY r),
hosts AS (SELECT host, count(DISTINCT coalesce('i' || doc_id, 'r' || r)) AS documents FROM d GROUP BY host),
f AS (SELECT host, key FROM (SELECT host, key, count(DISTINCT doc) AS n FROM k GROUP BY host, key) JOIN hosts USING (host) WHERE n > greatest(5, documents * 0.05)),
rm AS (SELECT r, sum(chars)::BIGINT AS n FROM k JOIN f USING (host, key) GROUP BY r),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(rm.n, 0) AS removed_chars
 FROM w LEFT JOIN dl USING (r) LEFT JOIN cov USING (r) LEFT JOIN rm USING (r))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (word_chars - removed_chars < 0.3 * word_chars) AS kept FROM b
"""
