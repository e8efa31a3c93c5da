"""Command lines: python -m millrace preprocess | index | analyze | retrieval | latency."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import build, chunking, evaluation, profiling, providers, retrieval
from .session import build as session
from .sources import datasets
from .sources.vector_store import VectorStore


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace", description=__doc__)
    top.add_argument("--master", default=None, help="Spark master; by default the one of the environment, else local[*]")
    commands = top.add_subparsers(dest="command", required=True)

    one = commands.add_parser("preprocess", help="raw records to passages")
    one.add_argument("source")
    one.add_argument("target", nargs="?")
    one.add_argument("--overwrite", action="store_true")
    one.add_argument("--dry-run", action="store_true")
    one.add_argument("--batches", type=int, default=1)
    one.add_argument("--batch-size", type=int, default=500)

    one = commands.add_parser("index", help="raw records of languages to a vector store")
    one.add_argument("root")
    one.add_argument("store")
    one.add_argument("--languages", nargs="+", default=["hi"])
    one.add_argument("--split", default="train", choices=["train", "validation"])
    one.add_argument("--strategy", default="adaptive")
    one.add_argument("--dimension", type=int, default=64)
    one.add_argument("--most-samples", type=int)
    one.add_argument("--base-url")
    one.add_argument("--overwrite", action="store_true")

    one = commands.add_parser("analyze", help="files, splits and a profile of a dataset folder")
    one.add_argument("root")
    one.add_argument("--sample", type=int, default=1000)

    for name in ("retrieval", "latency"):
        one = commands.add_parser(name, help=f"{name} benchmark of a query set against a store")
        one.add_argument("store")
        one.add_argument("queries")
        one.add_argument("--batches", type=int, default=5)
        one.add_argument("--warm-up", type=int, default=1)
        one.add_argument("--top-k", type=int, default=config.Settings().rag_top_k)
        one.add_argument("--json")
        one.add_argument("--markdown")
    return top


def benchmark(spark: SparkSession, args: argparse.Namespace) -> evaluation.Report:
    store = VectorStore(spark, args.store)
    dimension = store.validate()["dimension"]
    embedder = providers.hash_embedder(dimension)
    chunks = store.chunks().select("chunk_id", "document_id", "chunk_text")
    retriever = retrieval.Retriever(store.vectors(), chunks, lambda rows: providers.embed(rows, embedder, dimension, "query_id", "query"), retrieval.rerank, args.top_k)
    asked = datasets.read_queries(spark, args.queries).select(F.col("id").alias("query_id"), "query")
    whole = args.command == "latency"
    runner = evaluation.LatencyBenchmark(retriever, (lambda rows: providers.generate(rows, "query_id", "prompt")) if whole else None, (lambda rows: providers.synthesize(rows, "query_id", "prompt")) if whole else None)
    return runner.run(asked, args.batches, args.warm_up)


def run(spark: SparkSession, args: argparse.Namespace) -> object:
    """What a command prints."""
    if args.command == "preprocess":
        raw = datasets.open_parquet(spark, args.source)
        if args.dry_run:
            statistics, sample = build.dry_run(raw, args.batches, args.batch_size)
            return {"statistics": statistics.first().asDict(), "sample": [r.asDict() for r in sample.collect()]}
        if not args.target:
            raise SystemExit("preprocess needs a target unless it is a dry run")
        return build.preprocess_dataset(raw, args.target, args.overwrite, args.batch_size)
    if args.command == "index":
        engine = chunking.ChunkingEngine()
        indexer = build.DatasetIndexer(spark, VectorStore(spark, args.store), providers.hash_embedder(args.dimension), args.dimension, args.root, args.base_url, args.split, args.strategy, most_samples=args.most_samples, engine=engine)
        return indexer.run(args.languages, lambda x: print(json.dumps(x), file=sys.stderr), args.overwrite)
    if args.command == "analyze":
        found = datasets.list_repository(spark, args.root)
        out: dict = {"train": found.train, "validation": found.validation, "languages": found.languages, "files": []}
        for path in found.train + found.validation:
            facts = datasets.inspect_file(spark, f"{args.root.rstrip('/')}/{path}", 5)
            if facts["error"] is None:
                rows = datasets.open_parquet(spark, f"{args.root.rstrip('/')}/{path}").limit(args.sample)
                names = [c for c in rows.columns if rows.schema[c].dataType.simpleString() in ("string", "bigint", "int")]
                facts["profile"] = [r.asDict() for r in profiling.sample_profile(rows, *names).collect()] if names else []
                facts["roles"] = profiling.sample_roles(rows.columns)
            out["files"].append(facts)
        return out
    report = benchmark(spark, args)
    if args.json and args.markdown:
        report.save(spark, args.json, args.markdown)
    return {"queries": report.queries, "passed": report.passed, "statistics": report.statistics}


def main(given: list[str] | None = None) -> None:
    args = parser().parse_args(given)
    spark = session(args.master) if args.master else session()
    print(json.dumps(run(spark, args), indent=2, ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
