"""Latency benchmark of the whole request: warm-up, timed stages, percentiles, reports."""

from __future__ import annotations

import json
import platform
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import stored
from ..sources.vector_store import write_text
from . import analytics, grounding, retrieval
from .serving import Generator

# Stages of a report with their labels and budgets.
STAGES = {
    "guardrail_ms": ("Guardrail", "< 5"),
    "embedding_ms": ("Query embedding", "< 15"),
    "search_ms": ("Vector search", "< 5"),
    "rerank_ms": ("Hybrid rerank", "< 5"),
    "retrieval_total_ms": ("Total retrieval", "< 30"),
    "llm_ms": ("Generation", "< 80"),
    "grounding_ms": ("Grounding", "< 10"),
    "tts_ms": ("Speech synthesis", "< 50"),
    "total_ms": ("End to end", "< 200"),
}
SHARES = {"p50": 0.5, "p70": 0.7, "p90": 0.9, "p95": 0.95, "p100": 1.0}


@dataclass(frozen=True)
class Report:
    """statistics: per stage p50 to p100, mean, least and most, in milliseconds."""

    queries: int
    timestamp: str
    system: dict[str, str]
    statistics: dict[str, dict[str, float]]
    target_ms: float
    passed: bool
    runs: list[dict]

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False)

    def to_markdown(self) -> str:
        none = dict.fromkeys([*SHARES, "mean"], 0.0)
        lines = ["# Latency", "", f"- time (UTC): {self.timestamp}", f"- queries: {self.queries}", f"- platform: {self.system.get('platform', 'unknown')}", f"- target: P50 of at most {self.target_ms:g} ms, {'met' if self.passed else 'missed'}", ""]
        lines += ["| stage | P50 | P70 | P90 | P95 | P100 | mean | budget |", "| --- | --- | --- | --- | --- | --- | --- | --- |"]
        for stage, (label, budget) in STAGES.items():
            s = none | self.statistics.get(stage, {})
            lines.append(f"| {label} | " + " | ".join(f"{s[k]:.2f}" for k in [*SHARES, "mean"]) + f" | {budget} |")
        return "\n".join(lines) + "\n"

    def save(self, spark: SparkSession, json_path: str, markdown_path: str) -> None:
        write_text(spark, json_path, self.to_json())
        write_text(spark, markdown_path, self.to_markdown())


def statistics(runs: DataFrame) -> DataFrame:
    """Per stage of (stage, ms): percentiles, mean, least and most."""
    placed = analytics.all_percentiles(runs, list(SHARES.values()), list(SHARES))
    rest = runs.groupBy("stage").agg(F.round(F.avg("ms"), 3).alias("mean"), F.min("ms").alias("least"), F.max("ms").alias("most"))
    return placed.join(rest, "stage")


@dataclass
class LatencyBenchmark:
    """Times each stage of batches of queries. A batch's stage time is shared out among its queries."""

    retriever: retrieval.Retriever
    generate: Generator | None = None
    synthesize: Generator | None = None
    target_ms: float = 200.0

    def run_batch(self, asked: DataFrame) -> dict[str, float]:
        """Milliseconds a query of each stage, for one batch (query_id, query[, embedding])."""
        number = max(1, asked.count())
        start = time.perf_counter()
        found = self.retriever.retrieve(asked, timed=True)
        rows = stored(found.rows, "benchmark")
        taken = {"retrieval_total_ms": (time.perf_counter() - start) * 1000, **found.latencies}

        def timed(name: str, df: DataFrame) -> DataFrame:
            begin = time.perf_counter()
            df = stored(df, "benchmark")
            taken[name] = (time.perf_counter() - begin) * 1000
            return df

        if self.generate is not None:
            passed = rows.filter("allowed")
            made = timed("llm_ms", self.generate(passed.select("query_id", retrieval.rag_prompt(F.col("query"), F.col("evidence")).alias("prompt"))))
            texts = passed.select(F.col("query_id").alias("answer_id"), F.explode("evidence.text").alias("text"))
            timed("grounding_ms", grounding.verify(made.filter("text IS NOT NULL").select(F.col("query_id").alias("answer_id"), F.col("text").alias("answer")), texts))
            if self.synthesize is not None:
                timed("tts_ms", self.synthesize(made.select("query_id", F.col("text").alias("prompt"))))
        taken["total_ms"] = (time.perf_counter() - start) * 1000
        return {k: taken.get(k, 0.0) / number for k in STAGES}

    def run(self, asked: DataFrame, batches: int = 1, warm_up: int = 1, progress: Callable[[int, int], None] | None = None) -> Report:
        """warm_up batches that don't count, then all of them."""
        spark = asked.sparkSession
        asked = stored(asked, "asked")
        parts = [asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == i) for i in range(batches)]
        for part in parts[:warm_up]:
            self.run_batch(part)
        runs = []
        for i, part in enumerate(parts):
            runs.append(self.run_batch(part))
            if progress is not None:
                progress(i + 1, batches)
        rows = spark.createDataFrame([(k, float(v)) for r in runs for k, v in r.items()], "stage string, ms double")
        found = {r["stage"]: {k: r[k] for k in [*SHARES, "mean", "least", "most"]} for r in statistics(rows).collect()}  # one row a stage
        system = {"platform": platform.platform(), "python": platform.python_version(), "processor": platform.processor() or "CPU"}
        passed = found["total_ms"]["p50"] <= self.target_ms
        return Report(asked.count(), datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), system, found, self.target_ms, passed, runs)
