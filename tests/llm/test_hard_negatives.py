"""Hard negatives against all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, slice int, v string"


def brute(rows, every=5):
    """The whole result from (vec_id, vector, label) by Python integers."""
    fit = []
    for i, v, l in rows:
        if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(256 * float(np.float32(x))) for x in v]
            if sum(x * x for x in whole) < 2**62:
                fit.append((i, whole, l))
    out = []
    for a, va, la in fit:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, vb, strict=True)), b, lb) for b, vb, lb in fit if b != a and len(vb) == len(va))
        for ps, p, _ in [x for x in scored if x[2] == la][:5]:
            fits = [(n, -ns) for ns, n, l in scored if l != la and 50 * -ps <= 100 * -ns <= 95 * -ps][:3]
            out.extend((a, p, r, n, -ps, ns) for r, (n, ns) in enumerate(fits, 1))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, 0, "x") for i, v, l in rows], SCHEMA)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("size", "group", "slices", "pivots"), [(3, 16, 40, 20), (12, 1000, 8192, 512)])
def test_every_row_within_reach_is_met(spark, size, group, slices, pivots):
    rng = np.random.default_rng(size)
    centres = rng.normal(size=(12, size))
    points = np.concatenate([rng.normal(size=(200, size)), *[c + 0.1 * rng.normal(size=(25, size)) for c in centres], np.repeat(centres[:1], 120, axis=0)])
    rows = [(int(i), p, int(l)) for i, p, l in zip(rng.permutation(len(points)), points, rng.integers(0, 4, len(points)), strict=True)]
    assert got(H.mine(frame(spark, rows), F.col("vec_id") % 5 == 0, group_anchors=group, slice_rows=slices, pivots=pivots)) == brute(rows)


def test_bounds_keep_rows_from_groups_they_cannot_serve(spark):
    rng = np.random.default_rng(4)
    centres = 4 * np.eye(8)
    rows = [(i, centres[i % 4] + 0.02 * rng.normal(size=8), i // 8 % 2) for i in range(800)]
    sent = []
    kept = H._met

    def counting(anchors, found, *more):
        sent.append(found.count())
        return kept(anchors, found, *more)

    H._met = counting
    try:
        assert got(H.mine(frame(spark, rows), F.col("vec_id") % 5 == 0, group_anchors=20, pivots=64)) == brute(rows)
    finally:
        H._met = kept
    assert 800 <= sent[1] <= 800 * 8 / 2  # the join of positives: of eight groups or more, most rows serve those of one centre


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 2], 1), (1, [1, 2], 1), (2, [1, 1.2], 2), (3, [1, 1.2], 3), (4, [1, 1], None), (5, None, 1), (6, [None, 1], 1), (7, [nan, 1], 2), (8, [inf, 1], 2), (10, [1, 2, 3], 1), (11, [1, 2, 3.1], 1), (12, [1, 1, 2], 2), (15, [], 1), (16, [], 1), (17, [], 2), (20, [3e38, 1], 1), (25, [-1, -2], 1), (30, [1e6, 2e6], 1), (None, [1, 2], 1), (-5, [0.5, 1], 1), (33, [1, 1.3], 0)]
    want = brute(rows)
    assert {r[0] for r in want} >= {0, 10, 15, -5}
    assert got(H.mine(frame(spark, rows), F.col("vec_id") % 5 == 0)) == want
    assert got(H.mine(frame(spark, [*rows, (2, [1, 1.2], 2), (1, [9, 9], 7)]), F.col("vec_id") % 5 == 0)) == want
    assert got(H.mine(frame(spark, rows).limit(0), F.col("vec_id") % 5 == 0)) == []
    large = [(0, [2e6, 1e6], 1), (1, [2e6, 1e6 + 1], 1), (2, [1.4e6, 1e6], 2), (3, [1e6, 1e6], 3)]  # beyond 2^53
    assert got(H.mine(frame(spark, large), F.col("vec_id") % 5 == 0)) == brute(large)
