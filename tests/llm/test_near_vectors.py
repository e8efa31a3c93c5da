"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest

from millrace.llm import near_vectors as N


def brute(rows):
    """vec_id to (n_links, component_id, kept) from (vec_id, vector, label), all pairs compared."""
    rows = [r for r in rows if r[0] is not None]
    fit = [(i, np.array(v, dtype=float), l) for i, v, l in rows if l is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root = {i: i for i, _, _ in rows}
    links = dict.fromkeys(root, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    groups = {}
    for i, v, l in fit:
        groups.setdefault((l, len(v)), []).append((i, v / np.linalg.norm(v)))
    for mine in groups.values():
        ids, points = [i for i, _ in mine], np.stack([v for _, v in mine])
        for a, b in zip(*np.nonzero(np.triu(points @ points.T >= 0.93, 1)), strict=True):
            links[ids[a]] += 1
            links[ids[b]] += 1
            x, y = sorted((find(ids[a]), find(ids[b])))
            root[y] = x
    return {i: (links[i], find(i), find(i) == i) for i in root}


def got(df):
    rows = df.collect()
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert len(rows) == len(found)
    return found


SCHEMA = "vec_id long, embedding array<float>, label int, cell int, kind string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, 0, "x") for i, v, l in rows], schema)


@pytest.mark.parametrize(("size", "cell_rows", "block_rows"), [(3, 32, 16), (6, 24, 1000), (16, 50, 20)])
def test_no_link_is_lost_between_cells_and_blocks(spark, size, cell_rows, block_rows):
    rng = np.random.default_rng(size)
    centres = rng.normal(size=(30, size))
    points = [rng.normal(size=(300, size)), *[c + 0.3 * rng.normal(size=(12, size)) for c in centres], centres[0] + 0.05 * rng.normal(size=(400, size)), np.repeat(centres[1:2], 150, axis=0)]
    points = np.concatenate(points).astype(np.float32)
    rows = [(int(i), v, int(l)) for i, v, l in zip(rng.permutation(len(points)) * 3, points, rng.integers(0, 3, len(points)), strict=True)]
    assert got(N.near_groups(frame(spark, rows), cell_rows, block_rows)) == brute(rows)


def test_large_core_is_counted_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=32)
    points = np.concatenate([centre + 0.05 * rng.normal(size=(3000, 32)), rng.normal(size=(600, 32))]).astype(np.float32)
    df = frame(spark, [(i, v, 1) for i, v in enumerate(points)])
    cells = N._cells(df, 500)
    placed = N.assigned(df, cells).filter("kind = 0").groupBy("cell").count().collect()
    assert max(r["count"] for r in placed) >= 2990
    assert N._tasks(N.assigned(df, cells), 200).filter("vec_id < 3000").count() < 3000
    assert got(N.near_groups(df, 500, 200)) == brute([(i, v, 1) for i, v in enumerate(points)])


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0], 1), (2, [2, 0], 1), (3, [1, 0], 2), (4, [1, 0], None), (5, None, 1), (6, [0, 0], 1), (7, [1, None], 1), (8, [nan, 1], 1), (9, [inf, 1], 1), (10, [1, 0, 0], 1), (11, [3e38, 0, 0], 1), (12, [], 1), (13, [-1, 0], 1), (-5, [1, 0.1], 1)]
    want = brute(rows)
    assert want[1] == (2, -5, False) and want[10] == (1, 10, True)
    assert got(N.near_groups(frame(spark, rows))) == want
    nameless = got(N.near_groups(frame(spark, [*rows, (None, [1, 0], 1)])))
    assert nameless.pop(None) == (0, None, True) and nameless == want
    # a repeated id counts once, with its least label
    assert got(N.near_groups(frame(spark, [*rows, (2, [2, 0], 1), (2, [2, 0], 3)]))) == want
    assert N.near_groups(frame(spark, rows).limit(0)).count() == 0
