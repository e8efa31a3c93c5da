"""Operator 11, hard negatives by a nearest-neighbour join over Voronoi partitions.

Scores are inner products of whole numbers. With one more component, sqrt(M - |x|^2) for a row and 0 for an
anchor, where M is the largest squared length, an anchor's order of rows by score is that by Euclidean distance:
d^2 = |a|^2 + M - 2 score. Pivots are the rows of least hash, a bounded number. A row belongs to the partition of its nearest
pivot, an anchor to that of the pivot nearest to it; anchors of neighbouring partitions form groups of bounded size, and a
partition with more anchors than that is several groups.

First each anchor meets a slice of the rows of its own partition, which tells a score that its k-th match has at least. This
gives an anchor at distance t of its pivot an outer radius r, and a cap on scores gives an inner one: only rows between
t - r (or the inner radius - t) and t + r of the pivot can serve it. The union of these ranges is the bound of an anchor partition. Each row
is sent to those groups whose bounds hold its distance to their pivots, and to no other. There it meets the
group's anchors in slices of its partition of bounded rows, as an exact join by matrix products; the best of all slices are ranked per
anchor. This runs twice: for the positives (same label), then for negatives between half and 95 % of a positive's score.

So a task holds a group's anchors and a slice of rows, however large a label or partition is. The bounds save work
where vectors cluster; vectors without structure reach all groups, whose number is that of the anchors by GROUP_ANCHORS.

Defined cases: rows with a null label, id or vector, a null or non-finite component, or a squared length of 2^62 or more (its scores could
pass 64 bits) take no part; vectors of different lengths don't meet; a repeated vec_id counts once, with its least label and vector; equal scores go by
the smaller id; anchors without positives and positives without negatives give no row, and no score below zero has a negative; empty tables give no row; further columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship, stored
from .vectors import by_length, lists, one_per_id, rows_of

POSITIVES, NEGATIVES = 5, 3
#: Negatives have between half and 95 hundredths of a positive's score.
LEAST_PERCENT, MOST_PERCENT = 50, 95
MOST_PIVOTS, GROUP_ANCHORS, SLICE_ROWS = 512, 2048, 8192
#: Anchors multiplied at once with a slice.
STRIP = 256
#: Distances are widened by this part of the longest vector, so that rounding loses nothing.
SLACK = 1e-6
_NONE = -(2**63)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, dims, n2, v: whole-number vectors floor(scale * x) of the rows that take part."""
    ship(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            for rows, matrix in by_length(batch.column("embedding")):
                with np.errstate(over="ignore", invalid="ignore"):
                    whole = np.floor(scale * matrix)
                    fits = (whole * whole).sum(axis=1) < 2.0**62
                rows, whole = rows[fits], whole[fits].astype(np.int64)
                if len(rows):
                    taken = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id").take(taken), batch.column("label").take(taken), pa.array(np.full(len(rows), matrix.shape[1], dtype=np.int32)), pa.array((whole * whole).sum(axis=1)), lists(whole.astype(np.int32), pa.int32())],
                        names=["vec_id", "label", "dims", "n2", "v"],
                    )

    return vectors.filter("label is not null and embedding is not null").mapInArrow(run, "vec_id long, label long, dims int, n2 long, v array<int>")


class Space:
    """Pivots by length of the vectors, and distances to them."""

    def __init__(self, sample: pa.Table, most: int):
        self.most, self.pivots = float(most), {}
        for size, matrix, n2 in _parts(sample):
            self.pivots[size] = (matrix.astype(np.float64), np.sqrt(np.maximum(most - n2.astype(np.float64), 0)))

    def distances(self, matrix: np.ndarray, n2: np.ndarray, anchors: bool) -> np.ndarray:
        """Of rows, or of anchors, to all pivots of their length; a length without a pivot has the origin as its only one."""
        size, own = matrix.shape[1], n2.astype(np.float64)
        pivots, more = self.pivots.get(size, (np.zeros((1, size)), np.zeros(1)))
        products = matrix.astype(np.float64) @ pivots.T
        if not anchors:
            products += np.sqrt(np.maximum(self.most - own, 0))[:, None] * more
            own = np.full(len(own), self.most)
        pivot2 = (pivots * pivots).sum(axis=1) + more * more
        return np.sqrt(np.maximum(own[:, None] + pivot2 - 2 * products, 0))


def _parts(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, vectors, squared lengths) for each length in a table of quantised vectors."""
    dims = table["dims"].to_numpy()
    for size in np.unique(dims):
        part = table.filter(pa.array(dims == size))
        yield int(size), rows_of(part["v"], int(size)), part["n2"].to_numpy()


class Routes:
    """Where anchors and rows go: groups of anchors by partition, slices of rows by partition, bounds by anchor partition."""

    def __init__(self, space: Space, anchors: dict, rows: dict, group_anchors: int, slice_rows: int):
        self.space, self.bounds, self.group_anchors, self.of_cell, self.slices = space, {}, group_anchors, {}, {}
        self.groups = 0
        for size in sorted({s for s, _ in anchors}):
            order, filled = self._chain(size), group_anchors
            for cell in order:
                number = anchors.get((size, cell), 0)
                if not number:
                    continue
                if filled + number > group_anchors:
                    self.groups, filled = self.groups + max(1, -(-number // group_anchors)), 0
                blocks = max(1, -(-number // group_anchors))
                self.of_cell[size, cell] = list(range(self.groups - blocks, self.groups))
                filled = filled + number if blocks == 1 else group_anchors
        for key, number in rows.items():
            self.slices[key] = -(-number // slice_rows)

    def _chain(self, size: int) -> list[int]:
        """The partitions of a length, each followed by the nearest that is left."""
        if size not in self.space.pivots:
            return [0]
        pivots, more = self.space.pivots[size]
        left, order = set(range(1, len(more))), [0]
        whole = np.concatenate([pivots, more[:, None]], axis=1)
        while left:
            rest = np.array(sorted(left))
            order.append(int(rest[((whole[rest] - whole[order[-1]]) ** 2).sum(axis=1).argmin()]))
            left.remove(order[-1])
        return order

    def reached(self, size: int, distances: np.ndarray) -> np.ndarray:
        """rows x groups: whether a row at these distances of the pivots may serve a group."""
        out = np.zeros((len(distances), self.groups), dtype=bool)
        for (of, cell), groups in self.of_cell.items():
            if of == size and (of, cell) in self.bounds:
                least, most = self.bounds[of, cell]
                out[:, groups] |= ((distances[:, cell] >= least) & (distances[:, cell] <= most))[:, None]
        return out


def _mixed(ids: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """A number below `number` for each id, evenly."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(33)) % np.asarray(number, dtype=np.uint64)).astype(np.int64)


_TASK = ["dims", "grp", "cell", "slice"]


def _sent(df: DataFrame, route) -> DataFrame:
    """df with the task columns grp, cell and slice; route gives (row numbers, groups, cells, slices) of a batch of one length."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for size in np.unique(dims):
                part = batch.filter(pa.array(dims == size))
                rows, *task = route(part, int(size))
                for i in range(0, len(rows), 4096):
                    more = [pa.array(t[i : i + 4096].astype(np.int32)) for t in task]
                    taken = part.take(pa.array(rows[i : i + 4096]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, *more], names=[*part.schema.names, "grp", "cell", "slice"])

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, grp int, cell int, slice int")


def _rows(rows: DataFrame, routes: Routes, home: bool) -> DataFrame:
    """Each row once for every group it may serve, in its partition and slice; with home, only the first slices, for the groups of their own partition."""

    def route(part, size):
        d = routes.space.distances(rows_of(part["v"], size), part["n2"].to_numpy(), False)
        cell = d.argmin(axis=1)
        own = _mixed(part["vec_id"].to_numpy(), np.array([routes.slices.get((size, int(c)), 1) for c in cell]))
        if home:
            near = np.zeros((len(cell), routes.groups), dtype=bool)
            for c in np.unique(cell):
                near[np.ix_((cell == c) & (own == 0), routes.of_cell.get((size, int(c)), []))] = True
        else:
            near = routes.reached(size, d)
        which, group = np.nonzero(near)
        return which, group, cell[which], own[which]

    return _sent(rows, route)


def _anchors(anchors: DataFrame, routes: Routes, home: bool) -> DataFrame:
    """Each anchor once for every partition and slice that its group meets; with home, only for the first slice of its own."""
    by_size: dict[int, list] = {}
    for (size, cell), n in sorted(routes.slices.items()):
        by_size.setdefault(size, []).extend((cell, s) for s in range(n))

    def route(part, size):
        cells, ids = part["at"].to_numpy(), part["vec_id"].to_numpy()
        group, which = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for c in np.unique(cells):
            groups, mine = np.array(routes.of_cell[size, int(c)]), cells == c
            group[mine] = groups[_mixed(ids[mine], len(groups))]
        if home:
            return which, group, cells, np.zeros(len(ids))
        meets = np.array(by_size.get(size, []), dtype=np.int64).reshape(-1, 2)
        which = np.repeat(which, len(meets))
        return which, group[which], np.tile(meets[:, 0], len(ids)), np.tile(meets[:, 1], len(ids))

    return _sent(anchors, route)


def _first(scores: np.ndarray, k: int, least: int) -> np.ndarray:
    """The places of the k largest scores that reach `least`, in falling order; the first place of equal ones."""
    if k < len(scores):
        least = max(least, np.partition(scores, -k)[-k])
    found = np.flatnonzero(scores >= least)
    return found[np.argsort(-scores[found], kind="stable")[:k]]


def _strips(anchors: pa.Table, rows: pa.Table, exact: bool) -> Iterator[tuple]:
    """(anchor ids and labels, row ids and labels, first anchor, scores) in strips of anchors; rows in the order of their ids."""
    size = anchors["dims"][0].as_py()
    rows = rows.take(pa.array(np.argsort(rows["vec_id"].to_numpy(), kind="stable")))
    kind = np.float64 if exact else np.int64
    a, b = rows_of(anchors["v"], size).astype(kind), rows_of(rows["v"], size).astype(kind)
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    for i in range(0, len(a), STRIP):
        yield i, (a[i : i + STRIP] @ b.T).astype(np.int64), ids, labels


def positives_of(anchors: pa.Table, rows: pa.Table, k: int, exact: bool) -> pa.Table:
    """The best k rows of each anchor's label within one task, as (anchor_id, slot, id, score)."""
    out = []
    if anchors.num_rows and rows.num_rows:
        own, labels, least = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), anchors["least"].to_numpy()
        for at, scores, ids, its in _strips(anchors, rows, exact):
            by_label = {x: np.flatnonzero(its == x) for x in np.unique(labels[at : at + len(scores)])}
            for j, line in enumerate(scores, at):
                mine = by_label[labels[j]]
                mine = mine[ids[mine] != own[j]]
                if len(mine):
                    best = mine[_first(line[mine], k, least[j])]
                    out.append((np.full(len(best), own[j]), np.zeros(len(best), dtype=np.int64), ids[best], line[best]))
    return _pairs(out)


def negatives_of(anchors: pa.Table, rows: pa.Table, k: int, exact: bool) -> pa.Table:
    """The best k rows of other labels within each positive's range of scores, as (anchor_id, slot of the positive, id, score)."""
    out = []
    if anchors.num_rows and rows.num_rows:
        own, labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        ranges = list(zip(anchors["lows"].to_pylist(), anchors["highs"].to_pylist(), strict=True))
        for at, scores, ids, its in _strips(anchors, rows, exact):
            for j, line in enumerate(scores, at):
                lows, highs = ranges[j]
                other = np.flatnonzero((line >= min(lows)) & (line <= max(highs)) & (its != labels[j]))
                other = other[np.argsort(-line[other], kind="stable")]
                falling = -line[other]
                for slot, (low, high) in enumerate(zip(lows, highs, strict=True)):
                    first = np.searchsorted(falling, -high, "left")
                    best = other[first : min(first + k, np.searchsorted(falling, -low, "right"))]
                    if len(best):
                        out.append((np.full(len(best), own[j]), np.full(len(best), slot), ids[best], line[best]))
    return _pairs(out)


def _pairs(parts: list[tuple]) -> pa.Table:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * 4
    return pa.table(dict(zip(["anchor_id", "slot", "id", "score"], columns, strict=True)))


def _own_cell(space: Space, part: pa.RecordBatch, size: int) -> tuple:
    """Each row of a batch in its own partition."""
    cell = space.distances(rows_of(part["v"], size), part["n2"].to_numpy(), False).argmin(axis=1)
    return np.arange(len(cell)), np.zeros(len(cell)), cell, np.zeros(len(cell))


def _met(anchors: DataFrame, rows: DataFrame, local, k: int, exact: bool) -> DataFrame:
    """The best k per anchor and slot of all tasks, ranked from 1."""
    found = anchors.groupBy(*_TASK).cogroup(rows.groupBy(*_TASK)).applyInArrow(lambda a, b: local(a, b, k, exact), "anchor_id long, slot long, id long, score long")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _bounds(anchors: DataFrame, space: Space) -> dict:
    """(least, most) distance to the pivot of the rows that may serve a partition's anchors. Bounded: one row per partition."""
    span = F.greatest(F.lit(0.0), F.col("t") - F.col("outer"), F.col("inner") - F.col("t"))
    told = anchors.groupBy("dims", "at").agg(F.min(span).alias("least"), F.max(F.col("t") + F.col("outer")).alias("most")).collect()
    slack = SLACK * math.sqrt(space.most) + SLACK
    return {(r["dims"], r["at"]): (r["least"] - slack, r["most"] + slack) for r in told}


def _counts(df: DataFrame, cell: str) -> dict:
    return {(r["dims"], r[cell]): r["count"] for r in df.groupBy("dims", cell).count().collect()}


def _located(anchors: DataFrame, space: Space) -> DataFrame:
    """anchors with their partition `at` and the distance t to its pivot."""
    ship(anchors.sparkSession)

    def run(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for size in np.unique(dims):
                part = batch.filter(pa.array(dims == size))
                d = space.distances(rows_of(part["v"], int(size)), part["n2"].to_numpy(), True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], names=[*part.schema.names, "at", "t"])

    return anchors.mapInArrow(run, "vec_id long, label long, dims int, n2 long, v array<int>, at int, t double")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, group_anchors: int = GROUP_ANCHORS, slice_rows: int = SLICE_ROWS, pivots: int = MOST_PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among vectors (vec_id, label, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = stored(quantised(one_per_id(rows, "vec_id", "label", "embedding")), "quantised")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max("n2").alias("most")).first()
    exact = (seen["most"] or 0) < 2**53  # then products and their sums are exact in double precision
    sample = rows.select("dims", "n2", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(pivots, math.isqrt(seen["n"]) // 2))).toArrow()
    space = Space(sample, seen["most"] or 0)
    anchors = stored(_located(rows.filter(is_anchor), space), "anchors")
    at = _counts(anchors, "at")
    slices = _counts(_sent(rows.select("vec_id", "dims", "n2", "v"), lambda part, size: _own_cell(space, part, size)).select("dims", "cell"), "cell")

    def join(asked: DataFrame, local, k: int, bounded) -> DataFrame:
        """Two joins: with a slice of the own partition for bounds, then with every row within them."""
        routes = Routes(space, at, slices, group_anchors, slice_rows)
        first = _met(_anchors(asked, routes, True), _rows(rows, routes, True), local, k, exact)
        told = stored(bounded(asked, first), "bounds")
        routes.bounds = _bounds(told, space)
        return stored(_met(_anchors(told, routes, False), _rows(rows, routes, False), local, k, exact), "matches")

    def radius(score: Column) -> Column:
        """The distance from an anchor to a row of this score."""
        return F.sqrt(F.greatest(F.lit(0.0), F.col("n2").cast("double") + F.lit(space.most) - 2 * score.cast("double")))

    def for_positives(asked, first):
        kth = first.groupBy("anchor_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("found")).filter(F.col("found") == positives)
        least = asked.drop("least").join(kth, F.col("vec_id") == F.col("anchor_id"), "left").drop("anchor_id", "found")
        outer = F.when(F.col("kth").isNull(), F.lit(float("inf"))).otherwise(radius(F.col("kth")))
        return least.withColumn("least", F.coalesce("kth", F.lit(_NONE))).withColumn("outer", outer).withColumn("inner", F.lit(0.0)).drop("kth")

    found = join(anchors.withColumn("least", F.lit(_NONE)), positives_of, positives, for_positives)
    # 50 p <= 100 n <= 95 p, without a product that passes 64 bits
    ranges = found.filter("score >= 0").withColumn("low", F.expr(f"(score div 100) * {LEAST_PERCENT} + ((score % 100) * {LEAST_PERCENT} + 99) div 100"))
    ranges = ranges.withColumn("high", F.expr(f"(score div 100) * {MOST_PERCENT} + ((score % 100) * {MOST_PERCENT}) div 100")).filter("low <= high")
    ranges = ranges.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive"), "score", "low", "high"))).alias("asked"))
    asking = anchors.join(ranges, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    asking = stored(asking.select("*", F.col("asked.low").alias("lows"), F.col("asked.high").alias("highs")), "asking")

    def for_negatives(asked, first):
        kth = first.groupBy("anchor_id", "slot").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("found")).filter(F.col("found") == negatives)
        kth = kth.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), "kth"))).alias("known"))
        met = asked.join(kth, F.col("vec_id") == F.col("anchor_id"), "left").drop("anchor_id")
        met = met.withColumn("lows", F.expr("transform(lows, (x, i) -> greatest(x, coalesce(try_element_at(known, i), x)))"))
        return met.withColumn("outer", radius(F.array_min("lows"))).withColumn("inner", radius(F.array_max("highs"))).drop("known")

    hard = join(asking, negatives_of, negatives, for_negatives)
    named = asking.select(F.col("vec_id").alias("of"), F.posexplode("asked").alias("place", "asked")).select("of", "place", "asked.positive", F.col("asked.score").alias("positive_score"))
    met = hard.join(named, (F.col("anchor_id") == F.col("of")) & (F.col("slot") == F.col("place")))
    return met.select("anchor_id", F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 3
"""
