"""Queries on latency, breakers, dashboards and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import scratch
from ..operators import analytics, dedup, evaluation, serving
from ..sources.tables import table
from ..sources.vector_store import VectorStore
from ..streaming import live
from . import views
from .ingest import BATCHES
from .registry import PASSAGES, query

LATEST = "s AS (SELECT event_type AS stage, value AS ms FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500)"


@query("SELECT event_type AS stage, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return analytics.latency_stats(views.samples(spark, d))


@query(f"WITH {LATEST} SELECT stage, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.7), 6) AS p70, round(quantile_cont(ms, 1.0), 6) AS p100 FROM s GROUP BY stage")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return analytics.percentiles(analytics.latest(views.samples(spark, d), "ts", "event_id"), [0.5, 0.7, 1.0], ["p50", "p70", "p100"])


@query(f"WITH {LATEST}, q AS (SELECT stage, quantile_cont(ms, 0.5) AS p50 FROM s GROUP BY stage), c AS (SELECT event_type AS stage, count(*) FILTER (value < 300) AS success, count(*) FILTER (value >= 300 AND value < 400) AS rejected, count(*) FILTER (value >= 400) AS error FROM events GROUP BY 1) SELECT stage, success, rejected, error, p50 > 0 AND p50 < 200 AS within_budget FROM c JOIN q USING (stage)")
def latency_sla(spark: SparkSession, d: str) -> DataFrame:
    rows = views.samples(spark, d)
    counts = rows.groupBy("stage").agg(F.count_if(F.col("ms") < 300).alias("success"), F.count_if((F.col("ms") >= 300) & (F.col("ms") < 400)).alias("rejected"), F.count_if(F.col("ms") >= 400).alias("error"))
    p50 = analytics.percentiles(analytics.latest(rows, "ts", "event_id"), [0.5], ["p50"])
    return counts.join(p50, "stage").select("stage", "success", "rejected", "error", ((F.col("p50") > 0) & (F.col("p50") < analytics.BUDGET_MS)).alias("within_budget"))


@query("SELECT event_type AS stage, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.7), 6) AS p70, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS p100, quantile_cont(value, 0.5) <= 200 AS within_budget FROM events GROUP BY event_type")
def bench_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = analytics.all_percentiles(views.samples(spark, d), [0.5, 0.7, 0.9, 0.95, 1.0], ["p50", "p70", "p90", "p95", "p100"])
    return found.withColumn("within_budget", F.col("p50") <= analytics.BUDGET_MS)


@query("SELECT event_type AS stage, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.7), 6) AS p70, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS p100, round(avg(value), 3) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def benchmark_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of a latency benchmark from given runs of its stages."""
    return evaluation.statistics(views.samples(spark, d).select("stage", "ms"))


@query("WITH o AS (SELECT event_type AS stage, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT stage, max(v) FILTER (i = n // 2) AS p50, max(v) FILTER (i = floor(0.9 * n)) AS p90, max(v) FILTER (i = least(n - 1, floor(0.99 * n))) AS p99 FROM o GROUP BY stage")
def index_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return analytics.index_percentiles(views.samples(spark, d))


@query("""WITH o AS (SELECT event_type AS key, event_id AS seq, value < 300 AS ok, sum((value < 300)::INT) OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events),
r AS (SELECT key, seq, ok, sum((NOT ok)::INT) OVER (PARTITION BY key, g ORDER BY seq) AS in_a_row FROM o) SELECT key, seq, ok, in_a_row::BIGINT AS in_a_row, CASE WHEN in_a_row >= 3 THEN 'open' ELSE 'closed' END AS state FROM r""")
def breaker_state(spark: SparkSession, d: str) -> DataFrame:
    return analytics.breaker_states(table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), (F.col("value") < 300).alias("ok")))


@query("SELECT event_id, least(8.0, 0.5 * pow(2.0, event_id % 8)) AS pause FROM events")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", analytics.backoff(F.col("event_id") % 8).alias("pause"))


@query("SELECT event_id, CASE WHEN value <= 0 THEN 'idle' WHEN value <= 120 THEN 'good' WHEN value <= 200 THEN 'warn' ELSE 'hot' END AS tone, round(least(100.0, value / 200.0 * 100.0), 6) AS width FROM events")
def gauge_tone(spark: SparkSession, d: str) -> DataFrame:
    budget = F.lit(200.0)
    return table(spark, d, "events").select("event_id", analytics.gauge_tone(F.col("value"), budget).alias("tone"), F.round(analytics.gauge_width(F.col("value"), budget), 6).alias("width"))


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the folder as a stream."""
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parq[u]et")


@query(BATCHES)
def stream_dedup_log(spark: SparkSession, d: str) -> DataFrame:
    """Both levels of deduplication over a stream of three micro-batches in three calls, with a log as state; as dedup_batches. A micro-batch is all files of a part."""
    source, rows = scratch(spark, "passages"), views.passages(spark, d)
    log, out = dedup.DedupLog(spark, scratch(spark, "dedup-log")), None
    for i in range(3):
        rows.filter(F.col("ord") % 3 == i).write.mode("append").parquet(source)
        out = live.dedup_into(spark.readStream.schema(rows.schema).parquet(source), log)
    done = log.statistics()
    return out.select("ord", "is_selected", *[F.lit(done[c]).cast("long").alias(c) for c in ("content_duplicates", "conflicts")])


@query(f"WITH {PASSAGES} SELECT count(DISTINCT sha256('lang=' || target_lang || ':trans=' || translated_passage || ':eng=' || english_passage)) AS n FROM p")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import normalize

    norm = normalize(F.col("text"))
    rows = _stream(spark, d, "documents").select("doc_id", F.col("lang").alias("target_lang"), norm.alias("translated_passage"), norm.alias("english_passage"))
    return live.drain(spark, live.dedup(rows), "stream-dedup").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS stage, count(value) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def stream_latency(spark: SparkSession, d: str) -> DataFrame:
    out = live.drain(spark, live.latency(_stream(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))), "stream-latency", "update")
    last = out.groupBy("stage").agg(F.max_by(F.struct("n", "total", "least", "most"), "batch").alias("x"))
    return last.select("stage", "x.n", F.round("x.total", 4).alias("total"), "x.least", "x.most")


@query("SELECT key, in_a_row, state FROM (SELECT key, in_a_row::BIGINT AS in_a_row, CASE WHEN in_a_row >= 3 THEN 'open' ELSE 'closed' END AS state, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS z FROM (SELECT key, seq, sum((NOT ok)::INT) OVER (PARTITION BY key, g ORDER BY seq) AS in_a_row FROM (SELECT event_type AS key, event_id AS seq, value < 300 AS ok, sum((value < 300)::INT) OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events))) WHERE z = 1")
def stream_breaker(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), (F.col("value") < 300).alias("ok"))
    out = live.drain(spark, live.breaker(rows, recovery=None), "stream-breaker", "update")
    return out.groupBy("key").agg(F.max_by(F.struct("in_a_row", "state"), "batch").alias("x")).select("key", "x.in_a_row", "x.state")


def _timed(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream whose times can have a watermark."""
    return _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT * FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    """As a stream: windows come out once the watermark, ten minutes behind the latest event, has passed them."""
    return live.drain(spark, live.tumbling(_timed(spark, d)), "tumbling").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """As a stream: sessions that the watermark has passed."""
    return live.drain(spark, live.sessions(_timed(spark, d)), "sessions").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query(f"WITH {LATEST}, q AS (SELECT stage, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.7), 6) AS p70, round(quantile_cont(ms, 1.0), 6) AS p100 FROM s GROUP BY stage), a AS (SELECT event_type AS stage, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type) SELECT * FROM a JOIN q USING (stage)")
def latency_report(spark: SparkSession, d: str) -> DataFrame:
    """Every stage with its eight statistics in one answer."""
    return serving.latency_report(views.samples(spark, d), "ts", "event_id")


@query("WITH s AS (SELECT event_type AS stage, value AS ms FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 500) SELECT stage, count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.7), 6) AS p70, round(max(ms), 6) AS p100 FROM s GROUP BY stage")
def stream_recent(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each stage's last 500 samples, kept as state."""
    rows = _stream(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), F.col("value").alias("ms"))
    out = live.drain(spark, live.recent_percentiles(rows), "stream-recent", "update")
    last = out.groupBy("stage").agg(F.max_by(F.struct("n", "p50", "p70", "p100"), "batch").alias("x"))
    return last.select("stage", "x.n", *[F.round(f"x.{c}", 6).alias(c) for c in ("p50", "p70", "p100")])


@query("SELECT 2 * count(*) AS vectors, 2 * count(*) - 1 AS last, count(*) AS chunks FROM embeddings")
def stream_index_append(spark: SparkSession, d: str) -> DataFrame:
    """A store that a stream of vectors is appended to, with their chunks, in several calls while the source grows; the last call finds nothing new."""
    made, source = VectorStore(spark, scratch(spark, "streamed")), scratch(spark, "vectors")
    vectors = views.store(spark, d).drop("position", "label")
    made.save(vectors, "chunk_id", dimension=64)
    for part in (0, 1, 2, None):
        if part is not None:
            vectors.filter(F.col("chunk_id").cast("long") % 3 == part).write.mode("append").parquet(source)
        rows = spark.readStream.schema(vectors.schema).parquet(source).withColumn("chunk_text", F.lit("text"))
        live.append_to_index(rows, made, "chunk_id", chunks=["chunk_id", "chunk_text"])
    return made.load(64).agg(F.count(F.lit(1)).alias("vectors"), F.max("position").alias("last")).withColumn("chunks", F.lit(made.chunks().count()).cast("long"))


@query("SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE FOR i IN [0, 1, 2, 3]]) AS start, event_type, value FROM events) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """As a stream, as tumbling_windows."""
    return live.drain(spark, live.sliding(_timed(spark, d)), "sliding").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
