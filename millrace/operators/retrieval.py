"""Exact top-k, resolution, reranking, prompts and citations over batches of queries, and the whole of retrieval."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import broadcast_if_small, ship, stored
from ..functions import guard
from ..functions.text import lexical_tokens, strip
from ..functions.vectors import dot, hybrid_score, lexical_score

#: Queries of a block, and vectors scored against it at a time; queries beyond one block go through a table of blocks.
QUERY_BLOCK, STORE_BLOCK = 4096, 2048
# Layout of prompts.
SYSTEM_PROMPT = "Answer only from the reference passages below. If they don't hold the answer, say so. Reply in the language of the question, briefly and with facts only."
NO_EVIDENCE = "\n\n(No background evidence available. State that no context was found.)"
RULE = "-" * 50


def check_top_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError(f"top_k has to be a positive integer: {k!r}")
    return k


def top_k(store: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k vectors of a store (position, embedding) with the largest inner product; ties by position. An empty store is an error."""
    check_top_k(k)
    if store.isEmpty():
        raise ValueError("the store is empty")
    scored = store.select("*", dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return scored.orderBy(F.desc("score"), "position").limit(k)


#: Queries scored at a time, and numbers of candidates (rows times places) that are scored exactly at a time.
QUERY_PART, EXACT_PART = 512, 1 << 19


class _Best:
    """The k best hits so far of a block of queries; of equal scores those with the least position.

    Products in single precision, of vectors brought to length 1 at most, tell which vectors may still be among
    a query's k best: all whose product isn't further below its k-th score than rounding explains. Only these
    are scored in double, summed from the first place on as `dot` does, so equal vectors have equal scores.
    known: scores that each query's k-th best has at least; hits below them may be left out.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, known: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = np.linalg.norm(vectors, axis=1)
        self.unit = (vectors / np.where(self.norms > 0, self.norms, 1)[:, None]).astype(np.float32)
        self.known = np.full(len(ids), -np.inf) if known is None else known
        self.score, self.place, self.empty = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=np.int64), np.ones((len(ids), k), dtype=bool)

    def least(self) -> np.ndarray:
        """What a hit has to reach to be among the k best of each query."""
        return np.maximum(self.known, np.where(self.empty[:, -1], -np.inf, self.score[:, -1]))

    def add(self, positions: np.ndarray, vectors: np.ndarray) -> None:
        for i in range(0, len(positions), STORE_BLOCK):
            part, own = positions[i : i + STORE_BLOCK], vectors[i : i + STORE_BLOCK]
            top = float(np.linalg.norm(own, axis=1).max()) or 1.0
            small = np.ascontiguousarray((own / top).astype(np.float32).T)
            first = np.zeros(len(part), dtype=bool)  # a query of zeros has equal scores everywhere
            first[np.argsort(part, kind="stable")[: self.k]] = True
            slack = _slack(own.shape[1])
            for j in range(0, len(self.ids), QUERY_PART):
                rough = self.unit[j : j + QUERY_PART] @ small
                norms = self.norms[j : j + QUERY_PART]
                least = self.least()[j : j + QUERY_PART]
                bound = least / (np.where(norms > 0, norms, 1) * top) - slack
                if len(part) > self.k and np.isneginf(least).any():
                    bound = np.maximum(bound, np.partition(rough, -self.k, axis=1)[:, -self.k] - 2 * slack)
                may = ~(rough < np.nextafter(bound.astype(np.float32), np.float32(-np.inf))[:, None])
                if not norms.all():
                    may[norms == 0] = first
                self._merge(j, *np.divmod(np.flatnonzero(may), len(part)), part, own)

    def _merge(self, start: int, rows: np.ndarray, at: np.ndarray, positions: np.ndarray, vectors: np.ndarray) -> None:
        """Score candidates (query start + row, place at) and keep the best of them and those before."""
        step = max(1, EXACT_PART // max(1, vectors.shape[1]))
        for i in range(0, len(rows), step):
            q, v = rows[i : i + step] + start, at[i : i + step]
            score = np.cumsum(self.vectors[q] * vectors[v], axis=1)[:, -1] if vectors.shape[1] else np.zeros(len(q))
            keep = ~(score < self.least()[q])
            q, score, place = q[keep], score[keep], positions[v[keep]]
            if not len(q):
                continue
            met = np.unique(q)
            old = np.repeat(met, self.k)
            held = ((old, q), (self.score[met].reshape(-1), score), (self.place[met].reshape(-1), place), (self.empty[met].reshape(-1), np.zeros(len(q), dtype=bool)))
            q, score, place, empty = map(np.concatenate, held)
            order = np.lexsort((place, -score, empty, q))
            begin = np.searchsorted(q[order], met)
            best = order[begin[:, None] + np.arange(self.k)]
            self.score[met], self.place[met], self.empty[met] = score[best], place[best], empty[best]

    def rows(self) -> pa.RecordBatch:
        held = ~self.empty.T
        ids = np.broadcast_to(self.ids, held.shape)
        return pa.RecordBatch.from_arrays([pa.array(ids[held]), pa.array(self.place.T[held]), pa.array(self.score.T[held])], ["query_id", "position", "score"])


def _slack(dimension: int) -> float:
    """Twice what single precision can make of a product of two vectors of length 1 at most."""
    return 2 * (dimension + 8) * 2.0**-24


def _arrays(batch: pa.RecordBatch, key: str) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(key).to_numpy().astype(np.int64), np.asarray(batch.column("embedding").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)


#: Bytes of vectors in a block, and of the store's and the queries' blocks that meet in a cell of the grid; rows of the grid, and blocks that bounds are taken from, at most.
BLOCK_BYTES, CELL_STORE, CELL_QUERIES, MOST_ROWS, SEED_BLOCKS = 4 << 20, 32 << 20, 16 << 20, 1024, 8


def _first_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least ids of each distinct vector: of equal vectors no other can be among a query's k best."""
    if not vectors.size:
        return np.arange(len(ids))
    whole = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).reshape(-1)
    kind = np.unique(whole, return_inverse=True)[1].reshape(-1)
    order = np.lexsort((ids, kind))
    kind = kind[order]
    return np.sort(order[np.arange(len(kind)) - np.searchsorted(kind, kind) < k])


def _blocks(rows: DataFrame, key: str, most: int, k: int | None = None, more: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str] | None = None) -> DataFrame:
    """(block, ids, vectors, top, size) as rows of at most `most` ids and BLOCK_BYTES of vectors in bytes, the longest vectors of each part first; top: the largest length.

    k: of equal vectors that come together, the k with the least ids suffice. more: what adds columns to the rows, and
    their schema; it runs in the worker that packs them, since a second one would hold its own memory.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if k is not None:
                kept = _first_copies(ids, vectors, k)
                ids, vectors = ids[kept], vectors[kept]
            norms = np.linalg.norm(vectors, axis=1)
            order = np.argsort(-norms, kind="stable")
            step = max(1, min(most, BLOCK_BYTES // max(1, 8 * vectors.shape[1])))
            for i in range(0, len(ids), step):
                at = order[i : i + step]
                yield pa.RecordBatch.from_pydict({"ids": [ids[at].tobytes()], "vectors": [vectors[at].tobytes()], "top": [float(norms[at[0]])], "size": [len(at) * vectors.shape[1] * 8]})

        for batch in batches:
            if batch.num_rows:
                held.append(_arrays(batch, key))
                if sum(v.nbytes for _, v in held) >= 2 * BLOCK_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    schema = "ids binary, vectors binary, top double, size long"
    made = rows.mapInArrow(pack, schema) if more is None else rows.mapInArrow(lambda batches: more[0](pack(batches)), f"{schema}, {more[1]}")
    return made.withColumn("block", F.monotonically_increasing_id())


def _seed_step(seeds: int) -> int:
    """Queries that are held against so many seeds at a time: their products take no more room than those of a part of queries and a block."""
    return max(1, QUERY_PART * STORE_BLOCK // max(1, seeds))


def _opened(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    places = np.frombuffer(ids, dtype=np.int64)
    return places, np.frombuffer(vectors).reshape(len(places), -1)


@dataclass(frozen=True)
class Grid:
    """found: (query_id, position, score), k a query and cell. sent: (row, block) of the store's blocks that were sent to a row of the grid; possible: how many there are of those."""

    found: DataFrame
    sent: DataFrame
    possible: int

    def pruned(self) -> int:
        """Blocks kept from rows whose k-th scores they can't reach."""
        return self.possible - self.sent.count()


def grid_top_k(vectors: DataFrame, asked: DataFrame, k: int) -> Grid:
    """The k best of a store (position, embedding) for any number of queries (query_id, embedding), as an equi-join over a grid.

    Blocks of queries make the grid's rows, blocks of vectors its columns. A query block goes to every column, a block of vectors to
    those rows that it can serve: the SEED_BLOCKS with the longest vectors give each query a k-th score that it has at least, and
    |query| * (largest length in a block) bounds what a block can reach. In a cell the blocks come by falling
    length, and a query block is done when no further one can reach its k-th scores. A cell holds a bounded number of bytes of both sides,
    so its work is bounded, too, and there are as many tasks as cells; what grows with the square of the input is their number.
    """
    ship(vectors.sparkSession)
    store = stored(_blocks(vectors, "position", STORE_BLOCK, k), "store-blocks")
    first = store.orderBy(F.desc("top"), "block").limit(SEED_BLOCKS).collect()
    longest = first[0]["top"] if first and first[0]["top"] > 0 else 1.0
    seed = np.concatenate([(_opened(r["ids"], r["vectors"])[1] / longest).astype(np.float32) for r in first]) if first else np.empty((0, 0))
    enough, small = len(seed) >= k, np.ascontiguousarray(seed.T)
    step = _seed_step(len(seed))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor, need = [], []
            for ids, own in zip(batch.column("ids"), batch.column("vectors"), strict=True):
                own = _opened(ids.as_buffer(), own.as_buffer())[1]
                norms, least = np.linalg.norm(own, axis=1), np.full(len(own), -np.inf)
                unit = (own / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)
                for i in range(0, len(own) if enough else 0, step):
                    rough = np.partition(unit[i : i + step] @ small, -k, axis=1)[:, -k].astype(np.float64)
                    least[i : i + step] = (rough - _slack(own.shape[1])) * longest * norms[i : i + step]
                least[np.isnan(least)] = -np.inf
                floor.append(least.tobytes())
                need.append(float(np.where(norms > 0, least / np.where(norms > 0, norms, 1), -np.inf).min()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor, pa.binary()), pa.array(need, pa.float64())], names=[*batch.schema.names, "floor", "need"])

    queries = stored(_blocks(asked, "query_id", QUERY_BLOCK, more=(floors, "floor binary, need double")), "query-blocks")
    sizes = [df.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first() for df in (store, queries)]
    columns = max(1, -(-sizes[0][0] // CELL_STORE))
    rows = max(1, min(MOST_ROWS, -(-sizes[1][0] // CELL_QUERIES)))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    queries = queries.withColumn("row", dealt(rows))
    needs = {r["row"]: r["need"] for r in queries.groupBy("row").agg(F.min("need").alias("need")).collect()}
    slack = 1e-9 * max(1.0, first[0]["top"] if first else 0.0)
    wanted = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(n - slack - 1e-9 * abs(n)).alias("need")) for r, n in sorted(needs.items())]) if needs else F.array().cast("array<struct<row:int,need:double>>")
    sent = store.withColumn("column", dealt(columns)).withColumn("to", F.explode(F.filter(wanted, lambda w: F.col("top") >= w["need"])))
    sent = sent.select(F.col("to.row").alias("row"), "column", "block", "ids", "vectors", "top")
    met = queries.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).select("row", "column", "ids", "vectors", "floor")

    def cell(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        out = [pa.RecordBatch.from_pydict({"query_id": pa.array([], pa.int64()), "position": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        tops = theirs["top"].to_numpy()
        blocks = [(float(tops[i]), *_opened(theirs["ids"][i].as_buffer(), theirs["vectors"][i].as_buffer())) for i in np.argsort(-tops, kind="stable").tolist()]
        for x in zip(ours["ids"], ours["vectors"], ours["floor"], strict=True):
            x, own, floor = (y.as_buffer() for y in x)
            ids, own = _opened(x, own)
            floor = np.frombuffer(floor)
            best = _Best(ids, own, k, floor - 1e-9 * (1 + np.abs(floor)))
            for top, places, vectors in blocks:
                least = best.least()
                if (best.norms * top < least - 1e-9 * (1 + np.abs(least))).all():
                    break
                best.add(places, vectors)
            out.append(best.rows())
        return pa.Table.from_batches(out)

    cells = rows * columns
    met, dealt_out = met.repartition(cells, "row", "column"), sent.repartition(cells, "row", "column")
    found = met.groupBy("row", "column").cogroup(dealt_out.groupBy("row", "column")).applyInArrow(cell, "query_id long, position long, score double")
    return Grid(found, sent.select("row", "block"), sizes[0][1] * len(needs))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, position, score) per query, ranked from 0."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "position"))
    return found.withColumn("rank", number).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def batched_top_k(store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, position, score, rank from 0) for queries (query_id, embedding) against a store (position, embedding).

    Each task keeps the k best of its own vectors a query, and only those are shuffled and ranked. Up to
    QUERY_BLOCK queries go out with the task; more are a table of blocks, which meets the store's blocks in a
    grid (grid_top_k) and never passes the driver.
    """
    check_top_k(k)
    ship(store.sparkSession)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("query_id IS NOT NULL AND embedding IS NOT NULL")
    vectors = store.select(F.col("position").cast("long").alias("position"), "embedding").filter("embedding IS NOT NULL")
    schema = "query_id long, position long, score double"
    few = asked.limit(QUERY_BLOCK + 1).collect()
    if len(few) <= QUERY_BLOCK:
        ids, matrix = np.array([r["query_id"] for r in few], dtype=np.int64), np.array([r["embedding"] for r in few], dtype=np.float64)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(ids, matrix, k) if len(ids) else None
            for batch in batches:
                if best and batch.num_rows:
                    places, own = _arrays(batch, "position")
                    for i in range(0, len(places), STORE_BLOCK):
                        kept = i + _first_copies(places[i : i + STORE_BLOCK], own[i : i + STORE_BLOCK], k)
                        best.add(places[kept], own[kept])
            if best:
                yield best.rows()

        found = vectors.mapInArrow(score, schema)
    else:
        found = grid_top_k(vectors, stored(asked, "queries"), k).found
    return best_of(found, k)


def latest(chunks: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: of several the last one in order."""
    names = [c for c in chunks.columns if c != key]
    return chunks.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("row")).select(key, "row.*")


def resolve(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id", order: tuple[str, ...] = ()) -> DataFrame:
    """Hits with their chunks, in their order; hits without one are dropped. order: columns by which the last of chunks with one key counts."""
    return hits.join(latest(chunks, key, *order) if order else chunks, key)


def resolve_ids(chunks: DataFrame, ids: list, key: str = "chunk_id", order: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of a list of ids with `request`, their place in it: unknown ids are left out, repeated ones repeat. An empty list is an error."""
    if not ids:
        raise ValueError("no ids to resolve")
    asked = chunks.sparkSession.createDataFrame(list(enumerate(ids)), f"request int, {key} {chunks.schema[key].dataType.simpleString()}")
    return resolve(broadcast_if_small(asked, key), chunks, key, order)


def missing(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    return hits.join(chunks, key, "left_anti")


def pass_through(candidates: DataFrame, k: int) -> DataFrame:
    """The first k candidates of each query, in their order."""
    return candidates.filter(F.col("rank") < check_top_k(k)).withColumn("new_rank", F.col("rank"))


def pool_size(k: int, candidates: int | None = None, reranked: bool = True) -> int:
    """How many hits to fetch for k results: k, or with a reranker what is asked for, at least three a result and ten in all by default."""
    return check_top_k(k) if not reranked else check_top_k(candidates) if candidates is not None else max(3 * check_top_k(k), 10)


Reranker = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Retrieved:
    """rows: query_id, query, allowed, verdict, evidence (array of rank, chunk_id, document_id, score, text), missing (array of ids); latencies: milliseconds of each stage for the whole batch."""

    rows: DataFrame
    latencies: dict[str, float]


@dataclass
class Retriever:
    """Guardrail, embedding, search, resolution, reranking over a batch of queries.

    store (position, chunk_id, embedding), chunks (chunk_id, document_id, chunk_text), embed: from rows (query_id, query) to
    (query_id, embedding), not needed where queries bring theirs. Rejected queries reach none of the later stages
    and come back without evidence.
    """

    store: DataFrame
    chunks: DataFrame
    embed: Callable[[DataFrame], DataFrame] | None = None
    reranker: Reranker | None = None
    k: int = 5

    def retrieve(self, asked: DataFrame, k: int | None = None, candidates: int | None = None, timed: bool = False) -> Retrieved:
        """timed: each stage is run and stored by itself, and its time told; else all is one plan."""
        k = check_top_k(self.k if k is None else k)
        size, latencies = pool_size(k, candidates, self.reranker is not None), {}

        def stage(name: str, df: DataFrame) -> DataFrame:
            if not timed:
                return df
            start = time.perf_counter()
            df = stored(df, f"retrieve-{name}")
            latencies[f"{name}_ms"] = (time.perf_counter() - start) * 1000
            return df

        judged = stage("guardrail", asked.withColumn("verdict", guard.verdict(F.col("query"))))
        passed = judged.filter("verdict = 'pass'").drop("verdict")
        if self.embed is not None:
            made = stored(self.embed(passed.select("query_id", "query")).select("query_id", "embedding"), "query-vectors")  # one call a query
            passed = passed.select("query_id", "query").join(made, "query_id")
        passed = stage("embedding", passed.select("query_id", "query", "embedding"))
        hits = batched_top_k(self.store, passed, size).join(self.store.select("position", "chunk_id"), "position")
        hits = stage("search", hits)
        met = hits.join(self.chunks.select("chunk_id", "document_id", F.col("chunk_text").alias("text"), F.lit(True).alias("there")), "chunk_id", "left")
        met = stage("resolution", met)
        absent = met.filter("there IS NULL").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("absent"))
        found = met.filter("there").drop("there").join(passed.select("query_id", "query"), "query_id")
        best = stage("rerank", (self.reranker or _first)(found, k))
        one = F.struct(F.col("new_rank").alias("rank"), "chunk_id", "document_id", F.col("score").alias("score"), "text")
        evidence = best.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("evidence"))  # k a query
        rows = judged.select("query_id", "query", "verdict").join(evidence, "query_id", "left").join(absent, "query_id", "left")
        none = F.array().cast("array<string>")
        rows = rows.select("query_id", "query", (F.col("verdict") == "pass").alias("allowed"), "verdict", "evidence", F.coalesce(F.transform("absent", lambda x: x["chunk_id"]), none).alias("missing"))
        return Retrieved(rows, latencies)


def _first(candidates: DataFrame, k: int) -> DataFrame:
    """The first k resolved candidates of each query."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return candidates.withColumn("new_rank", number).filter(F.col("new_rank") <= k).withColumn("new_rank", F.col("new_rank") - 1)


def rerank(candidates: DataFrame, k: int, semantic_weight: float = 0.6, lexical_weight: float = 0.4, rrf_k: int = 60) -> DataFrame:
    """Candidates (query_id, query, rank, score, text) by hybrid score, k a query; new_rank from 0."""
    tokens = candidates.withColumn("q_tokens", lexical_tokens(F.col("query"))).withColumn("t_tokens", lexical_tokens(F.col("text")))
    scored = tokens.withColumn("lexical", lexical_score(F.col("q_tokens"), F.col("t_tokens"))).drop("q_tokens", "t_tokens")
    scored = scored.withColumn("hybrid", hybrid_score(F.col("score"), F.col("lexical"), F.col("rank"), semantic_weight, lexical_weight, rrf_k))
    order = Window.partitionBy("query_id").orderBy(F.desc("hybrid"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= check_top_k(k)).withColumn("new_rank", F.col("new_rank") - 1)


def system_prompt(custom: str | None = None) -> str:
    """A caller's own system prompt, or the usual one where it is blank."""
    return custom if custom and custom.strip() else SYSTEM_PROMPT


def rag_prompt(query: Column, evidence: Column) -> Column:
    """User prompt from a query and evidence, an array of (rank, chunk_id, document_id, text) in any order."""
    blocks = F.transform(F.sort_array(evidence), lambda e, i: F.concat(F.lit("--- [Passage "), (i + 1).cast("string"), F.lit(" (ID: "), e["chunk_id"], F.lit(", Doc: "), e["document_id"], F.lit(")] ---\n"), strip(e["text"])))
    full = F.concat(F.lit("Reference Evidence Passages:\n"), F.array_join(blocks, "\n\n"), F.lit(f"\n\n{RULE}\nUser Question: "), strip(query), F.lit("\nAnswer the question concisely and accurately based solely on the passages above:"))
    return F.when(F.coalesce(F.size(evidence), F.lit(0)) == 0, F.concat(F.lit("Question: "), strip(query), F.lit(NO_EVIDENCE))).otherwise(full)
