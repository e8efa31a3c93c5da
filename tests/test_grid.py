"""Top-k of large query sets as a grid join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval


def frame(spark, ids, vectors, key, parts=3):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], f"{key} long, embedding array<double>").repartition(parts)


def brute(ids, store, qids, queries, k):
    out = {}
    for q, v in zip(qids, queries, strict=True):
        scores = store @ v
        for rank, i in enumerate(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]):
            out[int(q), rank] = int(ids[i])
    return out


@pytest.fixture
def small(monkeypatch):
    for name, size in {"QUERY_BLOCK": 16, "STORE_BLOCK": 8, "CELL_STORE": 3000, "CELL_QUERIES": 2000}.items():
        monkeypatch.setattr(retrieval, name, size)


@pytest.mark.parametrize("kind", ["whole numbers", "lengths apart", "unit", "zeros"])
def test_equals_brute_force(spark, small, kind):
    rng = np.random.default_rng(3)
    store, queries = rng.normal(size=(300, 6)), rng.normal(size=(70, 6))
    if kind == "whole numbers":  # many ties
        store, queries = np.round(store), np.round(queries)
    elif kind == "lengths apart":
        store *= np.exp(rng.uniform(-4, 2, size=(300, 1)))
    elif kind == "unit":
        store /= np.linalg.norm(store, axis=1, keepdims=True)
    else:
        store[::2] = 0
        queries[::3] = 0
    ids, qids = rng.permutation(1000)[:300], rng.permutation(1000)[:70]
    found = retrieval.batched_top_k(frame(spark, ids, store, "position"), frame(spark, qids, queries, "query_id"), 5).collect()
    assert {(r.query_id, r["rank"]): r.position for r in found} == brute(ids, store, qids, queries, 5)
    assert len(found) == 70 * 5


def test_blocks_that_cannot_reach_the_scores_stay_away(spark, small):
    rng = np.random.default_rng(5)
    store, queries = rng.normal(size=(2000, 6)) * np.exp(rng.uniform(-6, 2, size=(2000, 1))), rng.normal(size=(60, 6))
    grid = retrieval.grid_top_k(frame(spark, range(2000), store, "position", 2), frame(spark, range(60), queries, "query_id"), 3)
    assert grid.possible > 200 and grid.pruned() > grid.possible / 2
    best = grid.found.groupBy("query_id").agg(F.max("score").alias("s")).collect()
    assert all(r.s == pytest.approx((store @ queries[r.query_id]).max()) for r in best)


def test_no_product_in_the_plan_at_any_dimension(spark):
    random = lambda n, key: spark.range(n).select(F.col("id").alias(key), F.expr("transform(sequence(1, 768), x -> hash(x, id) % 100 / 100D)").alias("embedding"))
    from millrace.cluster import stored

    found = retrieval.batched_top_k(stored(random(3000, "position"), "v"), stored(random(4200, "query_id").withColumnRenamed("id", "query_id"), "q"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert found.count() == 4200 * 3


def test_fewer_vectors_than_k_and_none(spark, small):
    q = frame(spark, range(40), np.ones((40, 2)), "query_id")
    assert retrieval.batched_top_k(frame(spark, [1, 2], np.ones((2, 2)), "position"), q, 5).count() == 80
    assert retrieval.batched_top_k(frame(spark, [1], np.ones((1, 2)), "position").limit(0), q, 5).count() == 0
