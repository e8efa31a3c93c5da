"""Operator 12, near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one of each group kept.

Vectors are compared where their labels are equal. Centroids are fitted by spherical k-means on a sample of
bounded rows and bytes (the rows of least hash); every vector then goes to the cell of its nearest centroid, its
home. A pair within the angle t of the threshold that lies in two cells has one of the two within t / 2 of the plane that
halves the space between their centroids. So a vector also visits each cell whose plane is that near, and no link is
lost at a border. Which of two visits counts is told by the cells each of a pair visits, so every link counts once.

Points of the sample that many others surround, enough to fill a cell, are centroids that don't move. Home vectors
within t / 2 of their centroid are its core: any two of them are linked, so a core of any size is counted, not
compared; what is further than 3 t / 2 from the centroid is linked with none of it. The rest of a cell
is cut into blocks by hash; a task compares two blocks as a matrix product and returns, for each row that has links, their
number and the least id of its component within the task. Components of all rows follow from these pairs, at most
one a row and task; links themselves are never listed.

Defined cases: a null label or vector, a zero vector or one with null or non-finite components links with nothing, and vectors of different
lengths don't link; a repeated vec_id counts once, with its least label and vector; rows without a vec_id link with nothing
and are each returned as (null, 0, null, true); an empty table gives no row; further columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import broadcast_if_small, ship, stored
from .graph import components
from .vectors import by_length, one_per_id, rows_of

COSINE = 0.93
#: The sample that centroids are fitted on, rows and bytes at most.
SAMPLE_ROWS, SAMPLE_BYTES = 8192, 16 << 20
#: Rows of the largest label that a cell should have; cells at most; rows of a block.
CELL_ROWS, MOST_CELLS, BLOCK_ROWS = 2048, 1024, 1024
ROUNDS = 8
#: Angles are widened by this much, so that rounding loses nothing.
SLACK = 1e-9
CORE, SHELL, VISITOR = range(3)


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    most = np.abs(matrix).max(axis=1, keepdims=True, initial=0)
    matrix = matrix / np.where(most > 0, most, 1)
    size = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(size > 0, size, 1)


def _apart(points: np.ndarray, cosine: float, chosen: list[np.ndarray], most: int) -> list[np.ndarray]:
    """chosen and those of points, in order, that are not within this cosine of one before, up to so many."""
    for p in points:
        if len(chosen) >= most:
            break
        if not chosen or (np.stack(chosen) @ p).max() < cosine:
            chosen.append(p)
    return chosen


def fit_cells(sample: np.ndarray, number: int, dense: int, half: float) -> np.ndarray:
    """Centroids of unit vectors: points with `dense` others of the sample within the angle `half`, and means of the rest, at most `number` of each."""
    near = math.cos(half)
    around = np.concatenate([(sample[i : i + 1024] @ sample.T >= near).sum(axis=1) for i in range(0, len(sample), 1024)])
    order = np.argsort(-around, kind="stable")
    fixed = _apart(sample[order[around[order] > dense]], near, [], number)
    seeds = _apart(sample, near, list(fixed), len(fixed) + number)
    centroids = np.stack(seeds)
    for _ in range(ROUNDS):
        home = (sample @ centroids.T).argmax(axis=1)
        for c in range(len(fixed), len(centroids)):
            if (mine := sample[home == c]).size and np.abs(total := mine.sum(axis=0)).max() > 0:
                centroids[c] = unit(total[None])[0]
    return np.stack(_apart(centroids[len(fixed) :], near, list(fixed), len(centroids)))


def spanned(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a matrix of links, the least id of its component; its own id where it has no link."""
    of_left, of_right = left.copy(), right.copy()
    open_left, open_right = links.any(axis=1), np.ones(len(right), dtype=bool)
    for a in range(len(left)):
        if not open_left[a]:
            continue
        rows, members, partners = np.array([a]), [a], []
        open_left[a] = False
        while len(rows):
            columns = np.flatnonzero(links[rows].any(axis=0) & open_right)
            open_right[columns] = False
            partners.extend(columns)
            rows = np.flatnonzero(links[:, columns].any(axis=1) & open_left) if len(columns) else columns
            open_left[rows] = False
            members.extend(rows)
        least = min(left[members].min(), right[partners].min())
        of_left[members] = least
        of_right[partners] = least
    return of_left, of_right


def _cells(vectors: DataFrame, cell_rows: int) -> dict[int, np.ndarray]:
    """Centroids by length of the vectors."""
    by_label = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("size"))
    seen = by_label.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("size").alias("size")).first()
    if not seen["n"]:
        return {}
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, seen["size"]))))
    sample = vectors.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()["embedding"]
    number = max(1, min(MOST_CELLS, seen["most"] // cell_rows))
    half, found = math.acos(COSINE) / 2, {}
    for _, matrix in by_length(sample):
        points = unit(matrix)
        points = points[np.abs(points).max(axis=1, initial=0) > 0]
        if len(points):
            found[points.shape[1]] = fit_cells(points, number, max(8, math.ceil(len(points) * cell_rows / seen["n"])), half)
    return found


def assigned(vectors: DataFrame, cells: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, label, dims, cell, home, visits (bits), kind, near, embedding: each vector in its home and in each cell it visits."""
    ship(vectors.sparkSession)
    angle = math.acos(COSINE) + SLACK
    value = dict(vectors.dtypes)["embedding"]
    spread = {size: np.sqrt(np.maximum(2 - 2 * c @ c.T, 0)) for size, c in cells.items()}

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            for rows, matrix in by_length(column):
                points = unit(matrix)
                there = np.abs(points).max(axis=1, initial=0) > 0
                rows, points, size = rows[there], points[there], matrix.shape[1]
                if not len(rows):
                    continue
                # without a centroid of this length all such vectors are one cell without a core
                centroids = cells.get(size)
                cosines = points @ centroids.T if centroids is not None else np.full((len(rows), 1), -1.0)
                home, at = cosines.argmax(axis=1), np.arange(len(rows))
                gap = cosines[at, home][:, None] - cosines
                visits = gap <= math.sin(angle / 2) * spread[size][home] + SLACK if centroids is not None else np.ones((len(rows), 1), dtype=bool)
                visits[at, home] = False
                bits = np.packbits(visits, axis=1)
                which, cell = np.nonzero(visits)
                which, cell = np.concatenate([at, which]), np.concatenate([home, cell])
                cosine, visitor = cosines[which, cell], np.arange(len(which)) >= len(at)
                kind = np.where(visitor, VISITOR, np.where(cosine >= math.cos(angle / 2 - 2 * SLACK) + SLACK, CORE, SHELL))
                near = cosine >= math.cos(1.5 * angle) - SLACK
                taken = pa.array(rows[which])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(taken), batch.column("label").take(taken), pa.array(np.full(len(which), size, dtype=np.int32)), pa.array(cell.astype(np.int32)),
                        pa.array(home[which].astype(np.int32)), pa.array([x.tobytes() for x in bits]).take(pa.array(which)), pa.array(kind.astype(np.int32)), pa.array(near), column.take(taken),
                    ],
                    names=["vec_id", "label", "dims", "cell", "home", "visits", "kind", "near", "embedding"],
                )

    return vectors.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, label {dict(vectors.dtypes)['label']}, dims int, cell int, home int, visits binary, kind int, near boolean, embedding {value}")


_CELL = ["label", "dims", "cell"]


def _tasks(placed: DataFrame, block_rows: int) -> DataFrame:
    """Each vector once for every pair of blocks it belongs to: (what, x, y), where what is shells, visitors or core."""
    is_kind = lambda k: F.col("kind") == k
    blocks = lambda chosen: F.ceil(F.count_if(chosen) / block_rows).cast("int")
    counts = placed.groupBy(*_CELL).agg(blocks(is_kind(SHELL)).alias("shells"), blocks(is_kind(VISITOR)).alias("visitors"), blocks(is_kind(CORE)).alias("cores"), blocks(F.col("near") & ~is_kind(CORE)).alias("nears"))
    met = placed.join(broadcast_if_small(counts, row_bytes=96), _CELL)
    own = lambda n: f"int(pmod(xxhash64(vec_id), greatest({n}, 1)))"
    all_of = lambda n, pair: f"transform(filter(sequence(0, {n}), x -> x < {n}), x -> named_struct('what', {pair[0]}, 'x', {pair[1]}, 'y', {pair[2]}))"
    shell = f"concat({all_of('shells', (f'{SHELL}', f'least(x, {own("shells")})', f'greatest(x, {own("shells")})'))}, {all_of('visitors', (f'{VISITOR}', own('shells'), 'x'))})"
    visitor = all_of("shells", (f"{VISITOR}", "x", own("visitors")))
    with_core = all_of("if(near, cores, 0)", (f"{CORE}", own("nears"), "x"))
    core = all_of("nears", (f"{CORE}", "x", own("cores")))
    tasks = f"CASE kind WHEN {CORE} THEN {core} WHEN {SHELL} THEN concat({shell}, {with_core}) ELSE concat({visitor}, {with_core}) END"
    return met.withColumn("own", F.expr(own("shells"))).withColumn("task", F.explode(F.expr(tasks))).select(*_CELL, "task.*", "own", "vec_id", "home", "visits", "kind", "embedding")


def _compare(rows: pa.Table) -> pa.Table:
    """vec_id, root, n of the vectors of one task that have links in it."""
    what, x, y, size, cell = (rows[c][0].as_py() for c in ("what", "x", "y", "dims", "cell"))
    kind, own = rows["kind"].to_numpy(), rows["own"].to_numpy()
    if what == SHELL:
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    else:
        left, right = (np.flatnonzero(kind != VISITOR), np.flatnonzero(kind == VISITOR)) if what == VISITOR else (np.flatnonzero(kind != CORE), np.flatnonzero(kind == CORE))
    ids, empty = rows["vec_id"].to_numpy(), pa.table({"vec_id": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    if not len(left) or not len(right):
        return empty
    points = unit(rows_of(rows["embedding"], size).astype(np.float64))
    links = points[left] @ points[right].T >= COSINE
    same = what == SHELL and x == y
    if same:
        np.fill_diagonal(links, False)
    home, visits = rows["home"].to_numpy(), rows["visits"].combine_chunks()
    a, b = np.nonzero(links)
    mine, its = left[a], right[b]
    if what == CORE:  # a near row on the left may be a visitor, whose partner on the right is the one at home
        mine, its = its, mine
    if (crossed := np.flatnonzero(home[its] != cell)).size:
        bits = np.unpackbits(np.frombuffer(b"".join(visits.take(pa.array(mine[crossed])).to_pylist()), dtype=np.uint8).reshape(len(crossed), -1), axis=1)
        other = home[its[crossed]]
        elsewhere = crossed[(bits[np.arange(len(crossed)), other] == 1) & (other < cell)]
        links[a[elsewhere], b[elsewhere]] = False
    of_left, of_right = spanned(links, ids[left], ids[right])
    n_left, n_right = links.sum(axis=1), links.sum(axis=0)
    parts = [(ids[left], of_left, n_left)] + ([] if same else [(ids[right], of_right, n_right)])
    out = [np.concatenate(p) for p in zip(*parts, strict=True)]
    kept = out[2] > 0
    return pa.table({"vec_id": out[0][kept].astype(np.int64), "root": out[1][kept].astype(np.int64), "n": out[2][kept].astype(np.int64)})


def linked(vectors: DataFrame, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, root, n): n links of a vector found in one place, all within the component of root. A stored table. Ids are unique."""
    cells = _cells(vectors, cell_rows)
    placed = stored(assigned(vectors, cells), "placed")
    ship(vectors.sparkSession)
    found = _tasks(placed, block_rows).groupBy(*_CELL, "what", "x", "y").applyInArrow(_compare, "vec_id long, root long, n long")
    core = placed.filter(F.col("kind") == CORE)
    sizes = core.groupBy(*_CELL).agg(F.min("vec_id").alias("root"), (F.count(F.lit(1)) - 1).alias("n"))
    inside = core.select(*_CELL, "vec_id").join(broadcast_if_small(sizes, row_bytes=96), _CELL).filter("n > 0").select("vec_id", "root", "n")
    return stored(found.unionByName(inside), "vector-links")


def near_groups(embeddings: DataFrame, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    unique = one_per_id(rows, "vec_id", "label", "embedding")
    links = linked(unique.filter("label is not null and embedding is not null"), cell_rows, block_rows)
    roots = components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    none = F.lit(None).cast("long")
    told = links.select("vec_id", "n", none.alias("component")).unionByName(roots.select(F.col("node").alias("vec_id"), F.lit(0).cast("long").alias("n"), F.col("root").alias("component")))
    told = told.unionByName(unique.select("vec_id", F.lit(0).cast("long").alias("n"), none.alias("component")))
    whole = told.groupBy("vec_id").agg(F.sum("n").alias("n_links"), F.coalesce(F.min("component"), F.col("vec_id")).alias("component_id"))
    nameless = rows.filter("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), none.alias("component_id"))
    return whole.unionByName(nameless).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""
