"""Chat and voice requests as batches: every gate of a request is a status, in the order the gates stand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import stored
from ..functions import audio as sound
from ..functions import guard
from . import analytics, grounding, retrieval

#: (key, prompt) to (key, text, ..., error if the call may fail), e.g. providers.generate with its columns named. With a ledger of its
#: own (providers.generate(..., ledger=...)) it also survives lost tasks and runs without a second call.
Generator = Callable[[DataFrame], DataFrame]

# Status codes, what they count as, and the parts of a latency breakdown.
HTTP = {
    "OK": 200,
    "INVALID_AUDIO": 400,
    "QUERY_REJECTED": 400,
    "UNGROUNDED_ANSWER": 422,
    "STT_FAILED": 500,
    "TTS_FAILED": 500,
    "RETRIEVAL_FAILED": 500,
    "LLM_FAILED": 500,
    "INTERNAL_ERROR": 500,
    "STT_PROVIDER_NOT_CONFIGURED": 501,
    "LLM_PROVIDER_NOT_CONFIGURED": 501,
    "TTS_PROVIDER_NOT_CONFIGURED": 501,
    "INDEX_NOT_AVAILABLE": 503,
}
OUTCOME = {"OK": "success", "INVALID_AUDIO": "rejected", "QUERY_REJECTED": "rejected", "UNGROUNDED_ANSWER": "none"}
BREAKDOWN = ["guardrail_ms", "embedding_ms", "search_ms", "resolution_ms", "rerank_ms", "llm_ms", "grounding_ms", "total_ms"]


def http_code(status: Column) -> Column:
    return sound.lookup({k: str(v) for k, v in HTTP.items()}, status).cast("int")


def outcome(status: Column) -> Column:
    """success, rejected, error, or none for what isn't recorded."""
    return F.coalesce(sound.lookup(OUTCOME, status), F.lit("error"))


def health(name: str = "rag-backend") -> dict[str, str]:
    return {"status": "ok", "service": name}


def latency_report(samples: DataFrame, *order: str) -> DataFrame:
    """Per stage of (stage, ms): n, total, mean, least, most of all samples, p50, p70, p100 of the latest."""
    recent = analytics.percentiles(analytics.latest(samples, *order), [0.5, 0.7, 1.0], ["p50", "p70", "p100"])
    return analytics.latency_stats(samples).join(recent, "stage")


def breakdown(latencies: dict[str, float]) -> Column:
    """A struct of the stages' milliseconds; stages that didn't run have 0."""
    whole = {k: float(latencies.get(k, 0.0)) for k in BREAKDOWN}
    whole["total_ms"] = whole["total_ms"] or sum(whole.values())
    return F.struct(*[F.lit(v).alias(k) for k, v in whole.items()])


def _finish(rows: DataFrame) -> DataFrame:
    return rows.withColumn("code", http_code(F.col("status"))).withColumn("outcome", outcome(F.col("status")))


def _asked(provider: Generator, rows: DataFrame, stage: str) -> DataFrame:
    """What a provider gives, with `error`, stored: it is called once, and what is judged is what is returned."""
    made = provider(rows)
    return stored(made if "error" in made.columns else made.withColumn("error", F.lit(None).cast("string")), stage)


def _answered(passed: DataFrame, store: DataFrame, chunks: DataFrame, generate: Generator, k: int, with_evidence: bool) -> DataFrame:
    """(query_id, answer, llm_error, verdict, score, flagged, citations) of queries that passed the gates; an answer that failed is null."""
    hits = retrieval.batched_top_k(store, passed, k).withColumn("chunk_id", F.col("position").cast("string"))
    found = stored(retrieval.resolve(hits, chunks).select("query_id", "rank", "chunk_id", "document_id", "chunk_text", "score"), "evidence")
    evidence = found.groupBy("query_id").agg(F.collect_list(F.struct("rank", "chunk_id", "document_id", F.col("chunk_text").alias("text"), F.round("score", 4).alias("score"))).alias("evidence"))  # k a query
    asked = passed.join(evidence, "query_id", "left")
    prompt = retrieval.rag_prompt(F.col("query"), F.col("evidence")) if with_evidence else F.trim("query")
    made = _asked(generate, asked.select("query_id", prompt.alias("prompt")), "answers").select("query_id", F.col("text").alias("answer"), F.col("error").alias("llm_error"))
    answers = made.filter("answer IS NOT NULL").select(F.col("query_id").alias("answer_id"), "answer")
    texts = found.select(F.col("query_id").alias("answer_id"), F.col("chunk_text").alias("text"))
    judged = grounding.verify(answers, texts).select(F.col("answer_id").alias("query_id"), "verdict", "score", "flagged")
    citations = F.transform(F.sort_array("evidence"), lambda e: F.struct(e["chunk_id"].alias("chunk_id"), e["document_id"].alias("document_id"), e["score"].alias("score"), e["text"].alias("text")))
    return asked.join(made, "query_id").join(judged, "query_id", "left").select("query_id", "answer", "llm_error", "verdict", "score", "flagged", citations.alias("citations"))


def chat(asked: DataFrame, store: DataFrame | None, chunks: DataFrame | None, generate: Generator | None, k: int = 5) -> DataFrame:
    """asked (query_id, query, embedding): query_id, status, code, outcome, answer, verdict, score, flagged (its unsupported claims), citations.

    Guardrail, then provider, then index; a provider's error is the status LLM_FAILED of its row (`message` has
    it); answers that lack evidence are flagged and still returned.
    """
    judged = asked.withColumn("gate", guard.verdict(F.col("query")))
    ready = "LLM_PROVIDER_NOT_CONFIGURED" if generate is None else "INDEX_NOT_AVAILABLE" if store is None or chunks is None else "OK"
    status = F.when(F.col("gate") != "pass", "QUERY_REJECTED").otherwise(ready)
    rows = judged.select("query_id", status.alias("status"))
    if ready != "OK":
        return _finish(rows)
    passed = judged.filter("gate = 'pass'").select("query_id", "query", "embedding")
    whole = rows.join(_answered(passed, store, chunks, generate, k, True), "query_id", "left")
    return _finish(_failed(whole, "llm_error", "LLM_FAILED"))


def _failed(rows: DataFrame, error: str, status: str) -> DataFrame:
    """Rows that are OK but have an error get its status, and the error as `message`."""
    bad = (F.col("status") == "OK") & F.col(error).isNotNull()
    message = F.when(bad, F.col(error))
    known = F.coalesce("message", message) if "message" in rows.columns else message
    return rows.withColumn("message", known).withColumn("status", F.when(bad, status).otherwise(F.col("status"))).drop(error)


def voice(uploads: DataFrame, transcribe: Generator | None, store: DataFrame | None, chunks: DataFrame | None, embed: Generator, generate: Generator | None, synthesize: Generator | None, k: int = 5) -> DataFrame:
    """uploads (query_id, audio, filename, content_type): as chat, with the transcription and audio in base64.

    Audio checks, speech to text, guardrail, generator, index; the prompt has no evidence; an answer that
    lacks evidence is refused before speech is made.
    """
    checked = uploads.withColumn("problem", sound.audio_problem(F.col("audio"), F.col("filename"), F.col("content_type")))
    good = checked.filter("problem IS NULL")
    base = checked.select("query_id", F.when(F.col("problem").isNotNull(), "INVALID_AUDIO").alias("bad"))
    if transcribe is None:
        return _finish(base.select("query_id", F.coalesce("bad", F.lit("STT_PROVIDER_NOT_CONFIGURED")).alias("status")))
    heard = _asked(transcribe, good.select("query_id", "audio"), "transcriptions").select("query_id", F.col("text").alias("query"), F.col("error").alias("stt_error"))
    heard = heard.withColumn("gate", guard.verdict(F.col("query")))
    rows = base.join(heard, "query_id", "left")
    ready = "LLM_PROVIDER_NOT_CONFIGURED" if generate is None else "INDEX_NOT_AVAILABLE" if store is None or chunks is None else "OK"
    status = F.coalesce(F.col("bad"), F.when(F.col("stt_error").isNotNull(), "STT_FAILED").when(F.col("gate") != "pass", "QUERY_REJECTED").otherwise(ready))
    rows = rows.select("query_id", "query", status.alias("status"), F.when(status == "STT_FAILED", F.col("stt_error")).alias("message"))
    if ready != "OK":
        return _finish(rows)
    vectors = _asked(embed, heard.filter("gate = 'pass'").select("query_id", F.col("query").alias("prompt")), "query-vectors").select("query_id", "embedding", F.col("error").alias("embed_error"))
    passed = heard.filter("gate = 'pass'").select("query_id", "query").join(vectors.filter("embed_error IS NULL").drop("embed_error"), "query_id")
    rows = _failed(rows.join(vectors.select("query_id", "embed_error"), "query_id", "left"), "embed_error", "RETRIEVAL_FAILED")
    whole = _failed(rows.join(_answered(passed, store, chunks, generate, k, False), "query_id", "left"), "llm_error", "LLM_FAILED")
    late = F.when((F.col("status") == "OK") & (F.coalesce("verdict", F.lit("flagged")) != "grounded"), "UNGROUNDED_ANSWER").when((F.col("status") == "OK") & F.lit(synthesize is None), "TTS_PROVIDER_NOT_CONFIGURED").otherwise(F.col("status"))
    whole = whole.withColumn("status", late)
    if synthesize is not None:
        whole = stored(whole, "judged")
        spoken = _asked(synthesize, whole.filter("status = 'OK'").select("query_id", F.col("answer").alias("prompt")), "speech").select("query_id", F.base64("audio").alias("speech"), F.col("error").alias("tts_error"))
        whole = _failed(whole.join(spoken, "query_id", "left"), "tts_error", "TTS_FAILED")
    return _finish(whole)
