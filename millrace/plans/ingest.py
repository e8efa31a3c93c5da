"""Queries on scans, sinks, ingestion, validation and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio, ids
from ..functions.text import byte_size, is_blank, shortened
from ..functions.vectors import is_valid, rounded
from ..operators import dedup, ingest, profiling, validate
from ..sources import datasets, tables
from ..sources.lines import ChunkStore
from ..sources.tables import table
from ..sources.vector_store import VectorStore, integrity
from . import views
from .registry import PASSAGES, norm, query


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def scan_parquet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 50 OFFSET 50")
def batch_slice(spark: SparkSession, d: str) -> DataFrame:
    return tables.batch(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), 1, "doc_id", size=50)


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 20")
def sample_head(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url").orderBy("page_id").limit(20)


@query("SELECT doc_id, text, lang FROM documents")
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text", "lang")
    path = tables.scratch(spark, "jsonl")
    tables.write_jsonl(rows, path)
    return tables.read_jsonl(spark, path, rows.schema)


@query(f"WITH {PASSAGES} SELECT document_id, query_id, target_lang, translated_passage, is_selected FROM p")
def write_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return tables.stored(views.passages(spark, d).select("document_id", "query_id", "target_lang", "translated_passage", "is_selected"), "passages")


@query("SELECT row_number() OVER (ORDER BY vec_id DESC) - 1 AS position, CAST(vec_id AS VARCHAR) AS chunk_id, round(list_sum([x::DOUBLE FOR x IN embedding]), 6) AS total FROM embeddings")
def vector_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    made = VectorStore(spark, tables.scratch(spark, "store"))
    made.save(views.store(spark, d).drop("position").withColumn("o", -F.col("chunk_id").cast("long")), "o", dimension=64)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return made.load(64).select("position", "chunk_id", rounded(total, 6).alias("total"))


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS positions, count(*) FILTER (len(embedding) <> 64) AS invalid, 0::BIGINT AS blank_ids, min(vec_id) AS least, max(vec_id) AS most FROM embeddings")
def vector_integrity(spark: SparkSession, d: str) -> DataFrame:
    return integrity(views.store(spark, d), 64)


@query("SELECT (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(*) FROM embeddings) AS n_manifest, (SELECT count(*) FROM documents JOIN embeddings ON doc_id = vec_id) AS n_chunks, (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM documents JOIN embeddings ON doc_id = vec_id) AS consistent")
def index_consistency(spark: SparkSession, d: str) -> DataFrame:
    made = VectorStore(spark, tables.scratch(spark, "index"))
    vectors = views.store(spark, d).drop("position")
    made.save(vectors, "chunk_id", dimension=64, chunks=views.chunks(spark, d).join(vectors.select("chunk_id"), "chunk_id", "left_semi"))
    n = F.count(F.lit(1))
    counts = made.vectors().agg(n.alias("n_vectors")).crossJoin(made.chunks().agg(n.alias("n_chunks")))  # one row each
    whole = counts.withColumn("n_manifest", F.lit(made.manifest()["count"]).cast("long"))
    return whole.select("n_vectors", "n_manifest", "n_chunks", ((F.col("n_vectors") == F.col("n_manifest")) & (F.col("n_vectors") == F.col("n_chunks"))).alias("consistent"))


@query("SELECT 2 * count(*) AS n, max(i) AS last FROM (SELECT (row_number() OVER (ORDER BY vec_id) - 1) + (SELECT count(*) FROM embeddings) AS i FROM embeddings)")
def vector_append(spark: SparkSession, d: str) -> DataFrame:
    made = VectorStore(spark, tables.scratch(spark, "append"))
    vectors = views.store(spark, d).drop("position")
    made.save(vectors, "chunk_id", dimension=64)
    made.append(vectors, "chunk_id")
    return made.load().agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN n_chars > 1000 THEN lang ELSE '' END, ''), nullif(source, ''), '') AS name FROM documents")
def alias_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, F.col("lang")).otherwise("").alias("first_name"), F.col("source").alias("second_name"))
    return rows.select("doc_id", ingest.first_filled(rows, "first_name", "other_name", "second_name").alias("name"))


FLAGS = "CASE doc_id % 8 WHEN 0 THEN '1' WHEN 1 THEN ' TRUE ' WHEN 2 THEN 'false' WHEN 3 THEN '2' WHEN 4 THEN 'maybe' WHEN 5 THEN '0' WHEN 6 THEN '1.0' ELSE NULL END"


@query(f"SELECT doc_id, coalesce(lower(trim({FLAGS})) IN ('1', 'true'), false) AS flag FROM documents")
def parse_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", ingest.parse_flag(F.expr(FLAGS)).alias("flag"))


@query("SELECT doc_id, sha256('MSMARCO-XI:' || lang || ':' || doc_id || ':0') AS document_id FROM documents")
def document_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", ids.document_id(F.col("lang"), F.col("doc_id"), F.lit(0)).alias("document_id"))


@query("SELECT doc_id, sha256('document_id=' || doc_id || ':strategy=passage:chunk_index=0') AS chunk_id FROM documents")
def chunk_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", ids.chunk_id(F.col("doc_id").cast("string"), F.lit("passage"), F.lit(0)).alias("chunk_id"))


RECORDS = f"""t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, role, text,
 first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS eng_query FROM conversations),
r AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN '' ELSE eng_query END AS query, n - CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS m FROM t),
f AS (SELECT sha256('MSMARCO-XI:hi:' || conv_id || ':' || i) AS document_id, conv_id AS query_id, i::INT AS passage_index, {norm("query")} AS query, {norm("eng_query")} AS eng_query,
 {norm("text")} AS translated_passage, role = 'assistant' AS is_selected FROM r WHERE i < m AND trim(text) <> '' AND trim(query) <> '' AND trim(eng_query) <> '')"""


@query(f"WITH {RECORDS} SELECT * FROM f")
def flatten_passages(spark: SparkSession, d: str) -> DataFrame:
    return ingest.flatten(views.records(spark, d)).select("document_id", "query_id", "passage_index", "query", "eng_query", "translated_passage", "is_selected")


@query("SELECT CASE WHEN conv_id % 7 = 0 THEN 'bad_query_id' WHEN trim(first_text) = '' THEN 'blank_queries' ELSE 'ok' END AS status, count(*) AS n FROM (SELECT conv_id, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id) GROUP BY 1")
def malformed_count(spark: SparkSession, d: str) -> DataFrame:
    raw = views.records(spark, d).withColumn("query_id", F.when(F.col("query_id").cast("long") % 7 == 0, F.concat(F.lit("x"), "query_id")).otherwise(F.col("query_id")))
    return ingest.canonical_records(raw).groupBy(F.coalesce("reject", F.lit("ok")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


#: Passages with faults put in by rules on query_id, for both engines.
FAULTS = {
    "document_id": "CASE WHEN query_id % 11 = 1 THEN '' WHEN query_id % 11 = 2 THEN '  ' WHEN query_id % 11 = 3 THEN 'other' ELSE document_id END",
    "passage_index": "CASE WHEN query_id % 13 = 4 THEN -1 ELSE passage_index END",
    "query": "CASE WHEN query_id % 17 = 5 THEN ' ' ELSE query END",
    "translated_passage": "CASE WHEN query_id % 19 = 6 THEN concat('a', chr(1)) ELSE translated_passage END",
    "target_lang": "CASE WHEN query_id % 23 = 7 THEN '' ELSE target_lang END",
    "is_selected": "CASE WHEN query_id % 29 = 8 THEN NULL ELSE is_selected END",
}
FAULTY = f"""{PASSAGES}, x AS (SELECT p.* REPLACE ({", ".join(f"{v} AS {k}" for k, v in FAULTS.items())}) FROM p),
e AS (SELECT query_id, unnest([
 CASE WHEN document_id = '' THEN 'empty_document_id' WHEN trim(document_id) = '' THEN 'whitespace_document_id'
  WHEN document_id <> sha256('MSMARCO-XI:' || target_lang || ':' || query_id || ':' || passage_index) THEN 'inconsistent_document_id' END,
 CASE WHEN passage_index < 0 THEN 'negative_passage_index' END, CASE WHEN trim(query) = '' THEN 'empty_query' END,
 CASE WHEN trim(translated_passage) = '' THEN 'empty_translated_passage' WHEN regexp_matches(translated_passage, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') THEN 'invalid_control_chars' END,
 CASE WHEN trim(english_passage) = '' THEN 'empty_english_passage' END,
 CASE WHEN trim(target_lang) = '' THEN 'empty_target_lang' END, CASE WHEN is_selected IS NULL THEN 'invalid_is_selected_type' END]) AS error_type FROM x)"""


def _faulty(spark: SparkSession, d: str) -> DataFrame:
    return views.passages(spark, d).withColumns({k: F.expr(v) for k, v in FAULTS.items()})


@query(f"WITH {FAULTY} SELECT query_id, count(error_type) AS n_errors, count(error_type) = 0 AS is_valid FROM e GROUP BY query_id")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    return validate.with_errors(_faulty(spark, d)).select("query_id", F.size("errors").cast("long").alias("n_errors"), "is_valid")


@query(f"WITH {FAULTY} SELECT error_type, count(*) AS n FROM e WHERE error_type IS NOT NULL GROUP BY error_type")
def validation_error_counts(spark: SparkSession, d: str) -> DataFrame:
    return validate.error_counts(_faulty(spark, d))


@query("SELECT vec_id, vec_id % 5 NOT IN (1, 2) AS is_ok FROM embeddings")
def vector_validity(spark: SparkSession, d: str) -> DataFrame:
    spoilt = F.when(F.col("vec_id") % 5 == 1, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 5 == 2, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", is_valid(spoilt, 64).alias("is_ok"))


SIGNATURES = "CASE doc_id % 8 WHEN 0 THEN '524946460000000057415645' WHEN 1 THEN '4F676753' WHEN 2 THEN '1A45DFA3' WHEN 3 THEN '000000186674797069736F6D' WHEN 4 THEN '494433' WHEN 5 THEN 'FFF150' WHEN 6 THEN 'FFFB90' ELSE '00112233' END"


@query(f"SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'audio/wav' WHEN 1 THEN 'audio/ogg' WHEN 2 THEN 'audio/webm' WHEN 3 THEN 'audio/mp4' WHEN 4 THEN 'audio/mpeg' WHEN 5 THEN 'audio/aac' WHEN 6 THEN 'audio/mpeg' END AS mime, CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 8 = 7 THEN 'unknown_signature' ELSE 'signature_mismatch' END AS problem FROM documents")
def audio_sniff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.unhex(F.expr(SIGNATURES)).alias("a"))
    return rows.select("doc_id", audio.sniff_input(F.col("a")).alias("mime"), audio.audio_problem(F.col("a"), F.lit("x.WAV"), F.lit("audio/x-wav; rate=1")).alias("problem"))


@query("SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'wav' WHEN 1 THEN 'opus' WHEN 4 THEN 'mp3' WHEN 5 THEN 'aac' WHEN 6 THEN 'mp3' END AS found, CASE WHEN doc_id % 8 IN (0, 1, 5) THEN 'signature_mismatch' END AS problem FROM documents")
def tts_sniff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.unhex(F.expr(SIGNATURES)).alias("a"))
    return rows.select("doc_id", audio.sniff_output(F.col("a")).alias("found"), audio.output_problem(F.col("a"), F.lit("MP3 ")).alias("problem"))


@query("SELECT doc_id, CASE WHEN regexp_full_match(lower(trim(CASE WHEN doc_id % 3 = 0 THEN upper(lang) || '-IN ' WHEN doc_id % 3 = 1 THEN lang ELSE source END)), '[a-z]{2,3}(-[a-z]{2})?') THEN lower(trim(CASE WHEN doc_id % 3 = 0 THEN upper(lang) || '-IN ' WHEN doc_id % 3 = 1 THEN lang ELSE source END)) END AS code FROM documents")
def language_code(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper("lang"), F.lit("-IN "))).when(F.col("doc_id") % 3 == 1, F.col("lang")).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", audio.language_code(raw).alias("code"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'audio/wav' WHEN 1 THEN 'audio/mpeg' WHEN 2 THEN 'audio/ogg' END AS mime FROM documents")
def mime_canonical(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE doc_id % 4 WHEN 0 THEN ' Audio/X-Wav ;rate=8000' WHEN 1 THEN 'audio/mp3' WHEN 2 THEN 'audio/opus;codecs=opus' ELSE 'text/plain' END")
    return table(spark, d, "documents").select("doc_id", audio.canonical_mime(raw).alias("mime"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'en-IN' ELSE 'unknown' END AS stt, CASE WHEN doc_id % 2 = 0 THEN 'od-IN' WHEN lang = 'en' THEN 'en-IN' ELSE 'hi-IN' END AS tts FROM documents")
def locale_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", audio.locale(F.col("lang"), "unknown").alias("stt"), audio.locale(F.when(F.col("doc_id") % 2 == 0, F.lit("OR ")).otherwise(F.col("lang")), "hi-IN").alias("tts"))


@query("SELECT doc_id, text FROM documents")
def base64_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.unbase64(F.base64(F.col("text").cast("binary"))).cast("string").alias("text"))


TWICE = f"{PASSAGES}, a AS (SELECT * FROM p UNION ALL SELECT p.* REPLACE (ord + 1000000000 AS ord, NOT is_selected AS is_selected) FROM p)"


def _twice(spark: SparkSession, d: str) -> DataFrame:
    """All passages, and all again later with the other flag."""
    rows = views.passages(spark, d)
    return rows.unionByName(rows.withColumn("ord", F.col("ord") + 1_000_000_000).withColumn("is_selected", ~F.col("is_selected")))


@query(f"WITH {TWICE} SELECT ord, document_id FROM a QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ord) = 1")
def dedup_identity(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_identity(_twice(spark, d)).select("ord", "document_id")


FP = "sha256('lang=' || target_lang || ':trans=' || translated_passage || ':eng=' || english_passage)"


@query(f"WITH {TWICE} SELECT ord, min(ord) OVER (PARTITION BY {FP}) AS place, is_selected FROM a QUALIFY row_number() OVER (PARTITION BY {FP} ORDER BY is_selected DESC, ord) = 1")
def dedup_content(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_content(_twice(spark, d)).select("ord", "place", "is_selected")


@query(f"""WITH {PASSAGES}, k AS (SELECT {FP} AS fp, ord, is_selected FROM p), g AS (SELECT fp, count(*) AS n, min(ord) AS f, min(ord) FILTER (is_selected) AS s, arg_min(is_selected, ord) AS ff FROM k GROUP BY fp)
SELECT fp, n, (CASE WHEN NOT ff AND s IS NOT NULL THEN 1 ELSE 0 END) + (SELECT count(*) FROM k WHERE k.fp = g.fp AND NOT k.is_selected AND k.ord > g.s) AS conflicts FROM g WHERE n > 1""")
def dedup_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return dedup.conflicts(views.passages(spark, d))


@query(f"WITH {TWICE}, b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ord) = 1) SELECT ord, is_selected FROM b QUALIFY row_number() OVER (PARTITION BY {FP} ORDER BY ord) = 1")
def dedup_incremental(spark: SparkSession, d: str) -> DataFrame:
    return dedup.incremental(_twice(spark, d)).select("ord", "is_selected")


@query(f"WITH {PASSAGES}, g AS (SELECT {FP} AS fp, count(*) AS n FROM p GROUP BY fp) SELECT count(*) AS n_groups, count(*) FILTER (n > 1) AS shared, max(n) AS largest FROM g")
def dedup_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return dedup.content_groups(views.passages(spark, d)).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") > 1).alias("shared"), F.max("n").alias("largest"))


@query(f"WITH {PASSAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY {FP} ORDER BY is_selected DESC, ord) AS rn FROM p) SELECT count(*) AS n_input, count(*) FILTER (rn > 1) AS removed, count(*) FILTER (rn = 1 AND (trim(query) = '' OR translated_passage = '')) AS invalid, count(*) FILTER (rn = 1 AND trim(query) <> '' AND translated_passage <> '') AS written FROM k")
def pipeline_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = views.passages(spark, d)
    kept = validate.with_errors(dedup.by_content(dedup.by_identity(rows))).select("ord", "is_valid")
    status = rows.select("ord").join(kept, "ord", "left")
    return status.agg(F.count(F.lit(1)).alias("n_input"), F.count_if(F.col("is_valid").isNull()).alias("removed"), F.count_if(~F.col("is_valid")).alias("invalid"), F.count_if("is_valid").alias("written"))


@query("SELECT count(*) AS n_passages, count(DISTINCT lang) AS n_langs, count(DISTINCT source) AS n_sources, count(DISTINCT doc_id) AS n_documents FROM documents")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    # Each distinct column is counted on its own: together they would multiply every row.
    rows = table(spark, d, "documents")
    counts = [rows.select(c).distinct().agg(F.count(F.lit(1)).alias(n)) for c, n in (("lang", "n_langs"), ("source", "n_sources"), ("doc_id", "n_documents"))]
    whole = rows.agg(F.count(F.lit(1)).alias("n_passages"))
    for one in counts:
        whole = whole.crossJoin(one)  # one row each
    return whole


@query("SELECT unnest(['text', 'lang', 'n_chars']) AS field, unnest([count(*) FILTER (text IS NULL OR text = ''), count(*) FILTER (lang IS NULL OR lang = ''), count(*) FILTER (n_chars IS NULL)]) AS missing FROM documents")
def missing_counts(spark: SparkSession, d: str) -> DataFrame:
    return profiling.missing_counts(table(spark, d, "documents"), "text", "lang", "n_chars")


@query("WITH l AS (SELECT length(text) AS v FROM documents WHERE text IS NOT NULL), s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM l) SELECT count(*) AS size, round(sum(v) / count(*), 2) AS mean, median(v) AS median, min(v) AS least, max(v) AS most, max(v) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(v) FILTER (i = round_even(0.9 * (n - 1), 0)) AS p90, max(v) FILTER (i = round_even(0.99 * (n - 1), 0)) AS p99 FROM s")
def length_profile(spark: SparkSession, d: str) -> DataFrame:
    return profiling.length_profile(table(spark, d, "documents"), "text")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return profiling.duplicate_ids(table(spark, d, "events"), "user_id")


@query("SELECT count(*) AS scanned, count(*) FILTER (trim(source) = '') AS blank_queries, count(*) FILTER (text IS NULL OR text = '') AS no_passages FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 1000)")
def split_health(spark: SparkSession, d: str) -> DataFrame:
    return profiling.split_health(table(spark, d, "documents"), "source", "text", "doc_id")


@query("SELECT unnest(['text', 'source', 'n_chars']) AS field, unnest([count(*) FILTER (text IS NULL OR text = ''), count(*) FILTER (source IS NULL OR source = ''), count(*) FILTER (n_chars IS NULL)]) AS missing, unnest([min(length(text)), min(length(source)), NULL]) AS least, unnest([max(length(text)), max(length(source)), NULL]) AS most, unnest([round(avg(length(text)), 4), round(avg(length(source)), 4), NULL]) AS mean FROM documents")
def sample_profile(spark: SparkSession, d: str) -> DataFrame:
    return profiling.sample_profile(table(spark, d, "documents"), "text", "source", "n_chars")


@query("SELECT * FROM (VALUES ('query_id', 'string', 0), ('query', 'string', 0), ('Eng_Query', 'string', 0), ('source_lang', 'string', 0), ('target_lang', 'string', 0), ('passages', 'struct<Translated_passages:array<string>,English_passages:array<string>,is_selected:array<string>>', 0), ('passages.Translated_passages', 'array<string>', 1), ('passages.English_passages', 'array<string>', 1), ('passages.is_selected', 'array<string>', 1)) AS t(path, type, depth)")
def schema_description(spark: SparkSession, d: str) -> DataFrame:
    found = profiling.describe(views.records(spark, d).schema)
    return spark.createDataFrame([(p, t, n) for p, t, _, n in found], "path string, type string, depth int")


@query()
def schema_paths(spark: SparkSession, d: str) -> DataFrame:
    return profiling.schema_paths(spark, views.records(spark, d).schema)


@query("SELECT * FROM (VALUES ('query_id', 'metadata'), ('query', 'query'), ('Eng_Query', 'query'), ('source_lang', 'metadata'), ('target_lang', 'metadata'), ('passages.Translated_passages', 'document'), ('passages.English_passages', 'document'), ('passages.is_selected', 'metadata')) AS t(path, role)")
def field_roles(spark: SparkSession, d: str) -> DataFrame:
    return schema_paths(spark, d).select("path", profiling.field_role(F.col("path")).alias("role"))


@query("SELECT ord, document_id FROM (WITH " + PASSAGES + " SELECT * FROM p WHERE trim(translated_passage) <> '' ORDER BY ord LIMIT 100)")
def limit_passages(spark: SparkSession, d: str) -> DataFrame:
    return views.passages(spark, d).filter(~is_blank(F.col("translated_passage"))).orderBy("ord").limit(100).select("ord", "document_id")


@query("SELECT row_number() OVER (ORDER BY user_id, event_id) - 1 AS position, event_id FROM events")
def vector_positions(spark: SparkSession, d: str) -> DataFrame:
    return tables.with_positions(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id").select("position", "event_id")


@query("SELECT (SELECT count(*) FROM lineitem) AS rows, 11 AS columns, true AS grouped")
def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Rows and columns of a table from the footers of its files."""
    path = tables.scratch(spark, "files")
    table(spark, d, "lineitem").hint("rebalance").write.parquet(path)  # files of bounded size, however large the table
    found = datasets.file_metadata(spark, path)
    return found.agg(F.sum("rows").alias("rows"), F.max(F.size("columns")).alias("columns"), (F.sum("row_groups") >= F.count(F.lit(1))).alias("grouped"))


@query("SELECT item_id AS id, 'en' AS lang, 'benchmark' AS category, text AS query FROM benchmark")
def query_set(spark: SparkSession, d: str) -> DataFrame:
    """A query set written as one JSON array and read again."""
    path = tables.scratch(spark, "query-set")
    one = F.struct(F.col("item_id").alias("id"), F.lit("en").alias("lang"), F.lit("benchmark").alias("category"), F.col("text").alias("query"))
    table(spark, d, "benchmark").agg(F.to_json(F.collect_list(one)).alias("value")).write.text(path)
    return datasets.read_queries(spark, path)


@query("SELECT doc_id, text, true AS read_alone FROM documents WHERE doc_id % 3 = 0")
def jsonl_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Every third document by its offset in JSON lines: index, ranged reads, and the line at the offset found alike in a scan."""
    made = ChunkStore(spark, tables.scratch(spark, "lines"), "doc_id bigint, text string", "doc_id")
    index = made.save(table(spark, d, "documents").select("doc_id", "text"))
    found = made.get(index.filter("key % 3 = 0").select("key", F.col("offset").alias("wanted")))
    scanned = datasets.jsonl_chunks(spark, f"{made.root}/lines", "doc_id bigint, text string").select("offset", F.xxhash64("doc_id", "text").alias("mark"))
    met = found.withColumn("mark", F.xxhash64("doc_id", "text")).join(scanned.withColumnRenamed("offset", "wanted"), ["wanted", "mark"], "left_semi")
    return met.select("doc_id", "text", F.lit(True).alias("read_alone"))


@query("SELECT doc_id AS record, text FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 100 = 0")
def resolve_by_offset(spark: SparkSession, d: str) -> DataFrame:
    """Hits, some of them twice, resolved by ranged reads of a store of JSON lines; ids without a line are left out."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    made = ChunkStore(spark, tables.scratch(spark, "chunk-lines"), "doc_id bigint, text string", "doc_id")
    made.save(rows)
    ids = rows.select(F.col("doc_id").alias("key"))
    hits = ids.filter("key % 50 = 0").unionAll(ids.filter("key % 100 = 0")).unionAll(ids.select(F.col("key") + 1_000_000_000))
    return made.get(hits).select(F.col("doc_id").alias("record"), "text")


@query("SELECT 'train' AS split, 'hi' AS language, count(*) FILTER (page_id % 2 = 0) AS n FROM pages UNION ALL SELECT 'validation', 'hi', count(*) FILTER (page_id % 2 = 1) FROM pages")
def dataset_splits(spark: SparkSession, d: str) -> DataFrame:
    """A dataset folder's splits, found by the names of its files."""
    root, rows = tables.scratch(spark, "splits"), table(spark, d, "pages").select("page_id")
    rows.filter("page_id % 2 = 0").write.parquet(f"{root}/train/hi-train.parquet")
    rows.filter("page_id % 2 = 1").write.parquet(f"{root}/validation/hi-val.parquet")
    counted = None
    for split in datasets.list_splits(spark, root):
        one = datasets.load_split(spark, root, split).agg(F.count(F.lit(1)).alias("n")).select(F.lit(split).alias("split"), F.lit("hi").alias("language"), "n")
        counted = one if counted is None else counted.unionAll(one)
    return counted


@query("SELECT (p // 500)::BIGINT AS batch, count(*) AS n, min(doc_id) AS least, max(doc_id) AS most FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) GROUP BY 1")
def parquet_batches(spark: SparkSession, d: str) -> DataFrame:
    """All rows in batches of exactly 500 in the order of the file, the last one shorter, in one pass."""
    rows = datasets.row_batches(spark, f"{d}/documents.parquet")
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || '...' END AS shown, CASE WHEN strlen(text) * 40 < 1024 THEN printf('%.1f B', strlen(text) * 40.0) WHEN strlen(text) * 40 < 1048576 THEN printf('%.1f KB', strlen(text) * 40.0 / 1024) ELSE printf('%.1f MB', strlen(text) * 40.0 / 1048576) END AS size FROM documents")
def display_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", shortened(F.col("text")).alias("shown"), byte_size(F.octet_length("text") * 40).alias("size"))


@query("SELECT unnest(['saved', 'appended', 'rolled back']) AS state, unnest([n, 2 * n, n]) AS vectors, unnest([n - 1, 2 * n - 1, n - 1]) AS last, 64::BIGINT AS dimension FROM (SELECT count(*) AS n FROM embeddings)")
def store_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """A store's manifest and rows after saving, appending and going back."""
    made, whole = VectorStore(spark, tables.scratch(spark, "lifecycle")), None
    vectors = views.store(spark, d).drop("position")
    for state, step in (("saved", lambda: made.save(vectors, "chunk_id", dimension=64)), ("appended", lambda: made.append(vectors, "chunk_id")), ("rolled back", made.rollback)):
        step()
        facts = made.validate(64)
        one = made.vectors().agg(F.lit(state).alias("state"), F.lit(facts["count"]).cast("long").alias("vectors"), F.max("position").alias("last"), F.lit(facts["dimension"]).cast("long").alias("dimension"))
        whole = one if whole is None else whole.unionAll(one)
    return whole


#: Three batches by `ord % 3`: what is kept, and the counters.
BATCHES = f"""WITH {PASSAGES}, k AS (SELECT {FP} AS fp, * FROM p), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY fp ORDER BY ord % 3, ord) = 1),
r AS (SELECT k.fp, k.ord, k.is_selected, f.is_selected AS f0, min(CASE WHEN k.is_selected AND k.ord <> f.ord THEN (k.ord % 3) * 1000000000 + k.ord END) OVER (PARTITION BY k.fp) AS s, (k.ord % 3) * 1000000000 + k.ord AS place, k.ord <> f.ord AS twice FROM k JOIN f USING (fp))
SELECT f.ord, f.is_selected, (SELECT count(*) FROM r WHERE twice) AS content_duplicates, (SELECT count(*) FROM r WHERE twice AND CASE WHEN f0 OR place > s THEN NOT is_selected ELSE is_selected END) AS conflicts FROM f"""


@query(BATCHES)
def dedup_batches(spark: SparkSession, d: str) -> DataFrame:
    """Three batches one after the other: what each keeps, and the counters at the end."""
    run, rows, kept = dedup.IncrementalDedup(), views.passages(spark, d), None
    for i in range(3):
        one = run.process(rows.filter(F.col("ord") % 3 == i)).select("ord", "is_selected")
        kept = one if kept is None else kept.unionAll(one)
    return kept.select("*", *[F.lit(run.statistics[c]).cast("long").alias(c) for c in ("content_duplicates", "conflicts")])
