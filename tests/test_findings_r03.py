"""One small test for each finding of the third round that was right."""

import os
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.functions import text
from millrace.llm import substrings
from millrace.operators import chunking, dedup, grounding, retrieval
from millrace.plans import analysis, serving
from millrace.sources import datasets


def test_a_quoted_passage_may_end_within_a_sentence(spark):
    evidence = [(0, "1", "d1", "first sentence. and no end")]
    rows = spark.createDataFrame([("what is the price of x", evidence)], "query string, evidence array<struct<rank:int,chunk_id:string,document_id:string,text:string>>")
    prompt = rows.select(retrieval.rag_prompt(F.col("query"), F.col("evidence"))).first()[0]
    answer = spark.createDataFrame([(serving._quoting()(prompt),)], "answer string")
    assert answer.select(text.claims(F.col("answer"))).first()[0] == ["first sentence.", "and no end", serving.UNHEARD]


def test_units_are_rounded_as_the_sql_rounds_them(spark, tmp_path):
    path = str(tmp_path / "embeddings.parquet")
    duckdb.sql(f"COPY (SELECT * FROM (VALUES (1, [1.0, -1e-8, 1e-8]::FLOAT[]), (2, [0.0, 0.0, -0.0]::FLOAT[]), (3, [-3.0, 4.0, 0.0]::FLOAT[])) t(vec_id, embedding)) TO '{path}' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    want = {k: repr(list(v)) for k, v in con.sql(entry.oracle_sql()["l2_normalize"]).fetchall()}
    got = {r["vec_id"]: repr(list(r["unit"])) for r in entry.queries()["l2_normalize"](spark, str(tmp_path)).collect()}
    assert got == want and "-0.0" in got[1]


FOLDER = "/root/testdata/sf0.001"


def parts_of(spark, tmp_path, *names):
    """A folder with tables of four files each."""
    for name in names:
        spark.read.parquet(f"{FOLDER}/{name}.parquet").repartition(4).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_a_micro_batch_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    made, scratch = [], analysis.scratch
    monkeypatch.setattr(analysis, "scratch", lambda s, name: made.append((name, scratch(s, name))) or made[-1][1])
    out = entry.queries()["stream_dedup_log"](spark, parts_of(spark, tmp_path, "documents", "labels"))
    assert out.count() > 0
    source = dict(made)["passages"].removeprefix("file://")
    assert len([x for x in os.listdir(source) if x.endswith(".parquet")]) > 3


def test_files_of_a_large_table_are_bounded(spark, tmp_path, monkeypatch):
    seen, own = [], datasets.file_metadata
    monkeypatch.setattr(datasets, "file_metadata", lambda s, path: seen.append(path) or own(s, path))
    held = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        assert entry.queries()["file_metadata"](spark, parts_of(spark, tmp_path, "lineitem")).first()["grouped"]
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", held)
    assert own(spark, seen[0]).count() > 3


def test_grounding_shuffles_its_texts_once(spark):
    answers = spark.createDataFrame([(1, "One fish. Two 22 birds."), (2, "!!!")], "answer_id long, answer string")
    held = spark.createDataFrame([(1, "a fish of 22"), (1, "birds two"), (2, "so !!! it is"), (3, "x")], "answer_id long, text string")
    for sequence in (False, True):
        scores = grounding.claim_scores(answers, held, sequence)
        assert scores._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        found = {(r["answer_id"], r["claim_no"]): r["score"] for r in scores.collect()}
        assert found[2, 0] == 1.0 and found[1, 1] > 0.3 and 0.3 < found[1, 0] < 1


def test_hot_seeds_make_no_inner_join(spark, monkeypatch):
    plans, stored = [], substrings.stored
    monkeypatch.setattr(substrings, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
    monkeypatch.setattr(substrings, "HOT_SEED", 1)
    monkeypatch.setattr(substrings, "HOT_SAMPLE", 1.0)
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, words) for i in range(5)], "doc_id long, text string")
    assert substrings._links(docs, substrings.K, substrings.W).count() > 0
    assert len(plans) == 2 and not any("Join Inner" in p for p in plans)


@pytest.mark.parametrize("single", [True, False])
def test_scores_of_equal_vectors_are_equal_and_copies_cost_little(single, monkeypatch):
    """Of many copies and near ties in single precision, the k with the least positions are found, and few are scored exactly."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 24))
    store = np.concatenate((np.repeat(base[:1], 500, axis=0), base, base * (1 + 1e-12), np.zeros((40, 24))))
    ids = rng.permutation(len(store)).astype(np.int64) - 300
    asked = np.concatenate((base[:20], np.zeros((3, 24)), 1e30 * base[:2], 1e-30 * base[2:4]))
    monkeypatch.setattr(retrieval, "STORE_BLOCK", 64 if single else 2048)
    best, scored, merge = retrieval._Best(np.arange(len(asked)), asked, 5), [], retrieval._Best._merge
    monkeypatch.setattr(retrieval._Best, "_merge", lambda self, j, rows, *more: scored.append(len(rows)) or merge(self, j, rows, *more))
    kept = retrieval._first_copies(ids, store, 5)
    best.add(ids[kept], store[kept])
    found = {}
    for q, p in zip(best.rows()["query_id"].to_pylist(), best.rows()["position"].to_pylist(), strict=True):
        found.setdefault(q, []).append(p)
    for q, v in enumerate(asked):
        score = [sum((float(x * y) for x, y in zip(v, w, strict=True)), 0.0) for w in store]
        assert found[q] == [int(ids[i]) for i in sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:5]]
    assert sum(scored) < len(asked) * len(store) / 4


def test_cells_of_a_grid_have_tasks_of_their_own(spark, monkeypatch):
    for name, size in {"QUERY_BLOCK": 16, "STORE_BLOCK": 8, "CELL_STORE": 3000, "CELL_QUERIES": 2000}.items():
        monkeypatch.setattr(retrieval, name, size)
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(400)], "position long, embedding array<double>")
    found = retrieval.grid_top_k(rows, rows.withColumnRenamed("position", "query_id"), 2).found
    assert found.rdd.getNumPartitions() > 12


def test_chunks_are_made_once_to_be_measured(spark, monkeypatch):
    """Sentences are split once for the sentence and the adaptive strategy, and not again for what is selected."""
    plans, stored = [], chunking.stored
    monkeypatch.setattr(chunking, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
    texts = ["", " ", "One. Two! Three? Four. " * 30, "word " * 700 + ".", "a" * 600 + ". b. c.", "x" * 501, "x" * 500 + ".", "!" + " " * 300 + "y" * 450 + ".", "One. Two.", None, "𝒳" * 501 + " a. b." * 3, "".join(f"s{i} is here. " for i in range(300))]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate([*texts, texts[2]])] + [("2", texts[2])], "document_id string, text string")
    found = chunking.quality(chunking.chunk_all(rows), rows, rows.filter("document_id IN ('2', '3')").select("document_id"))
    got = {r["strategy"]: r for r in found.collect()}
    assert len(plans) == 1 and plans[0].count("([.?!।]+)") == 1
    for name, parts in chunking.STRATEGIES.items():
        own = chunking.chunker(name, parts)(rows)
        assert got[name]["chunks"] == own.count() and got[name]["duplicate_ids"] == own.count() - own.select("chunk_id").distinct().count()
        assert got[name]["selected_chunks"] == own.filter("document_id IN ('2', '3')").count() and got[name]["output_chars"] == own.agg(F.sum("character_count")).first()[0]
    every = {r["document_id"]: r["rule"] for r in rows.select("document_id", chunking.adaptive_rule(F.col("text")).alias("rule")).collect()}
    assert [every[str(i)] for i in (4, 5, 6, 7, 10)] == ["token", "token", "passage", "sentence", "token"]


def test_equal_passages_are_sent_once_and_not_sorted(spark, monkeypatch):
    rows = [(f"d{i}", i, f"t{i}", f"t{i}" if i % 3 else None if i % 2 else f"e{i}") for i in range(12)] + [("d12", 12, None, None)]
    batch = spark.createDataFrame(rows, "document_id string, ord long, translated_passage string, english_passage string").repartition(3)
    monkeypatch.setattr(dedup, "broadcast_if_small", lambda df, **more: df)
    found = dedup._rows_of(batch, batch.filter("ord % 4 <> 1").select("document_id", "ord"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("THEN null ELSE english_passage") + plan.count("WHEN NOT") > 0
    assert "(ord#" in plan and "<= 12" in plan
    assert dedup._rows_of(batch, batch.filter("ord < 0").select("document_id", "ord")).count() == 0
    assert found.columns == batch.columns and sorted(map(tuple, found.collect())) == sorted(r for r in rows if r[1] % 4 != 1)


def test_files_of_languages_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    made, scratch = [], serving.scratch
    monkeypatch.setattr(serving, "scratch", lambda s, name: made.append((name, scratch(s, name))) or made[-1][1])
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = entry.queries()["index_languages"](spark, parts_of(spark, tmp_path, "conversations")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    folder = dict(made)["languages"].removeprefix("file://")
    assert len(rows) == 2 and all(len([x for x in os.listdir(f"{folder}/{name}") if x.endswith(".parquet")]) > 1 for name in ("hintrain.parquet", "bentrain.parquet"))


def batches_of(ids, vectors, key, rows=5000):
    for i in range(0, len(ids), rows):
        own = vectors[i : i + rows]
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + rows]), pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1], own.reshape(-1))], [key, "embedding"])


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("copies", [False, True])
def test_memory_of_scoring_does_not_grow_with_the_queries(spark, monkeypatch, copies):
    """What a task of the direct search holds for 4,000 queries, with different vectors and with copies of one; of copies beyond k none is scored."""
    rng = np.random.default_rng(11)
    vectors = np.repeat(rng.normal(size=(1, 16)), 6000, axis=0) if copies else rng.normal(size=(12_000, 16))
    ids, asked = rng.permutation(len(vectors)).astype(np.int64), rng.normal(size=(4000, 16))
    tasks, scored = [], []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema: tasks.append(f) or spark.createDataFrame([], schema))
    retrieval.batched_top_k(spark.createDataFrame([(0, [1.0] * 16)], "position long, embedding array<double>"), spark.createDataFrame([(i, v) for i, v in enumerate(asked.tolist())], "query_id long, embedding array<double>"), 15)
    if copies:
        merge = retrieval._Best._merge
        monkeypatch.setattr(retrieval._Best, "_merge", lambda self, j, rows, *more: scored.append(len(rows)) or merge(self, j, rows, *more))
    (out,), most = peak_mb(lambda: list(tasks[0](batches_of(ids, vectors, "position"))))
    assert most < 40
    assert not copies or sum(scored) <= 4000 * 15 * 6
    found = dict.fromkeys(range(5), ())
    for q, p in zip(out["query_id"].to_pylist(), out["position"].to_pylist(), strict=True):
        if q in found:
            found[q] += (p,)
    for q in found:
        score = np.cumsum(asked[q] * vectors, axis=1)[:, -1]
        assert found[q] == tuple(ids[np.lexsort((ids, -score))[:15]].tolist())


def test_bounds_of_queries_take_one_worker_and_bounded_products(spark, monkeypatch):
    """Blocks of queries are packed and bounded by one Python worker a task, against the seeds in parts."""
    plans, tasks, stored, own = [], [], retrieval.stored, type(spark.range(0)).mapInArrow
    monkeypatch.setattr(retrieval, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or stored(df, name))
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema: tasks.append(f) or own(self, f, schema))
    store = spark.range(0, 24_000, 1, 2).select(F.col("id").alias("position"), F.expr("transform(sequence(1, 4), x -> hash(x, id) % 1000 / 100D)").alias("embedding"))
    retrieval.grid_top_k(store, store.limit(20).withColumnRenamed("position", "query_id"), 3)
    assert dict(plans)["query-blocks"].count("MapInArrow") == 1
    queries = np.random.default_rng(1).normal(size=(4096, 4))
    out, most = peak_mb(lambda: list(tasks[1](batches_of(np.arange(4096), queries, "query_id"))))
    assert most < 24
    held = np.array([r["embedding"] for r in store.collect()])
    ids, floor = (np.concatenate([np.frombuffer(x, dtype) for b in out for x in b[name].to_pylist()]) for name, dtype in (("ids", np.int64), ("floor", np.float64)))
    kth = np.partition(queries[ids] @ held.T, -3, axis=1)[:, -3]
    assert len(ids) == 4096 and (floor <= kth).all() and (floor > 0.5 * kth).all()
