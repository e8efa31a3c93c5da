"""Operator 5, fuzzy repeated passages by collinear chaining.

1. Seeds: hashes of k-word windows, thinned to minimisers (the least hash of every w neighbouring
   windows), so any k + w - 1 equal words share one.
2. Each seed's occurrences are linked to those in the first and in the last earlier document that has it
   (doc_id, then place), never to all: a passage that many documents share gives two links per occurrence
   at most. Seeds that a sample shows to be hot are linked within parts of neighbouring doc_ids, and the
   first and last ones of the earlier parts joined to them; the links are the same either way. A link
   without a second one in its pair of documents counts if another link of its document is close by.
3. Links of a pair of documents are chained in order on both sides. The chain score (a weight per seed
   less a cost per word of gap) comes from prefix maxima in a Fenwick tree over the partner's places.
4. The words around each chain are fetched from both documents and aligned: equal runs, resynchronised
   after edits, extended to both sides while the alignment gains. Where it stops before the chain's end
   (a gap of other words), it starts anew at the chain's next link outside, so a chain may give several stretches.
5. Aligned stretches of a document that overlap are joined; those of `least_words` or more are passages.

Rows: doc_id, start_word, end_word (exclusive), n_words, src_doc_id, src_start_word, src_end_word,
matched_words. src is an earlier document (smaller doc_id) with the longest part of the passage.

Defined cases: null and empty texts and those below k + w - 1 words have no seeds; rows without a doc_id
take no part; rows that repeat a doc_id are the same document, and where their texts differ the one with
the least hash stands for it and the others take no part; repeats within one document aren't reported;
very long texts are read whole; of equal stretches the source with the least doc_id is told; an empty
table gives no row; columns other than doc_id (a whole number) and text aren't read, and all are kept by
`without_passages`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import broadcast_if_small, ship, stored
from .groups import grouped, unused
from .memory import enter
from .words import slices, windows, words_of

K, W = 6, 10
SEED_WEIGHT, GAP_COST = 8.0, 0.25
LEAST_SEEDS = 2
LEAST_PART = 8
LEAST_WORDS = 45
#: Words that two stretches have in common if they are one passage; stretches that only touch are two.
OVERLAP = 4
MARGIN = 32
RESYNC = 32
HOT_SEED, HOT_SAMPLE, PART_ROWS = 50_000, 1 / 64, 1_000_000
LEAST_SALTS, MOST_SALTS = 64, 1024
ASKS = 256
#: How far the source places of single links in one request may lie apart.
SPREAD = 256
#: What may be left over at the edge of a cut.
LOOSE = b" \t\r\n.,;:!?"


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w neighbours, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(hashes: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text number, place in words) of the chosen k-word windows of concatenated texts."""
    grams = windows(hashes, k)
    n = len(grams) - w + 1
    if n <= 0:
        return grams[:0], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = owner[:n] == owner[w + k - 2 : w + k - 2 + n]
    least = np.where(inside, _sliding(grams, w, np.minimum), np.uint64(0))
    padded = np.concatenate((np.zeros(w - 1, dtype=np.uint64), least, np.zeros(w - 1, dtype=np.uint64)))
    at = np.flatnonzero((_sliding(padded, w, np.maximum) == grams) & (grams != 0))
    return grams[at], owner[at], at - first[owner[at]]


def chain(here: np.ndarray, there: np.ndarray, weight: float = SEED_WEIGHT, cost: float = GAP_COST) -> list[list[int]]:
    """Collinear chains of links, best first, no link in two of them. Links are sorted by (here, there)."""
    ranks = (np.unique(there, return_inverse=True)[1] + 1).tolist()
    size = max(ranks)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    n = len(ranks)
    sums = (cost * (here + there)).tolist()
    places = here.tolist()
    score, parent = [weight] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and places[j] == places[i]:
            best = (-1e18, -1)
            r = ranks[j] - 1
            while r:
                best = max(best, tree[r])
                r &= r - 1
            if best[0] - sums[j] > 0:
                score[j], parent[j] = weight + best[0] - sums[j], best[1]
            j += 1
        for x in range(i, j):
            value, r = (score[x] + sums[x], x), ranks[x]
            while r <= size:
                if tree[r] < value:
                    tree[r] = value
                r += r & -r
        i = j
    used, chains = [False] * n, []
    for end in sorted(range(n), key=lambda x: -score[x]):
        links, x = [], end
        while x >= 0 and not used[x]:
            used[x] = True
            links.append(x)
            x = parent[x]
        if links:
            chains.append(links[::-1])
    return chains


def walk(a: np.ndarray, b: np.ndarray, reach: int = RESYNC) -> tuple[int, int, int]:
    """Align prefixes of a and b from their first words on: the ends and matches at the best score (matches less edits)."""
    i = j = matches = 0
    score, best = 0, (0, 0, 0, 0)
    while i < len(a) and j < len(b):
        n = min(len(a) - i, len(b) - j)
        differ = a[i : i + n] != b[j : j + n]
        run = int(differ.argmax()) if differ.any() else n
        i, j, matches, score = i + run, j + run, matches + run, score + run
        if score > best[0]:
            best = (score, i, j, matches)
        x, y = a[i : i + reach + 3], b[j : j + reach + 3]
        if len(x) < 3 or len(y) < 3:
            break
        equal = x[:, None] == y[None, :]
        met = equal[:-2, :-2] & equal[1:-1, 1:-1] & equal[2:, 2:]
        p, q = np.nonzero(met)
        if not len(p):
            break
        k = int(np.argmin(np.maximum(p, q) * 100 + p + q))
        edits = int(max(p[k], q[k]))
        score -= edits
        if score < best[0] - reach:
            break
        i, j = i + int(p[k]), j + int(q[k])
    return best[1:]


def stretches(a: np.ndarray, b: np.ndarray, here: list[int], there: list[int], k: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Aligned stretches (lo, hi, src_lo, src_hi, matches) of a and b around a chain's links: each link lies in one."""
    done = 0
    for p, q in zip(here, there, strict=True):
        if p + k <= done:
            continue
        right = walk(a[p:], b[q:])
        left = walk(a[min(done, p) : p][::-1], b[:q][::-1])
        yield p - left[0], p + right[0], q - left[1], q + right[1], left[2] + right[2]
        done = max(done, p + right[0])


def _seeds(docs: DataFrame, k: int, w: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substrings")
        for batch in batches:
            for piece in slices(batch, "text"):
                words = words_of(piece.column("text"))
                seed, owner, place = minimisers(words.hashes, words.first, k, w)
                if len(seed):
                    yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), piece.column("doc_id").take(pa.array(owner)), pa.array(place.astype(np.int32))], ["seed", "doc_id", "place"])

    return docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, "seed long, doc_id long, place int")


def _links(docs: DataFrame, k: int, w: int) -> DataFrame:
    """(doc_id, src, place, src_place): each occurrence of a seed with those in the first and the last earlier document that has it."""
    seeds = _seeds(docs, k, w)
    sample = _seeds(docs.sample(HOT_SAMPLE, seed=5), k, w).groupBy("seed").count()
    hot = stored(sample.filter(F.col("count") >= HOT_SEED * HOT_SAMPLE).select("seed", "count", F.lit(True).alias("hot")), "hot-seeds")
    first, last = F.min(F.struct("doc_id", "place")), F.max(F.struct("doc_id", (-F.col("place")).alias("back")))

    def linked(rows: DataFrame, *keys: str) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1)
        return rows.select("*", first.over(window).alias("first"), last.over(window).alias("last"))

    if not hot.limit(1).count():
        rows = linked(seeds, "seed")
    else:  # hot seeds in parts of neighbouring doc_ids; what earlier parts hold is joined to each part, so links are the same
        salts = min(MOST_SALTS, max(LEAST_SALTS, math.ceil(hot.agg(F.max("count")).first()[0] / HOT_SAMPLE / PART_ROWS)))
        cuts = docs.filter("doc_id is not null").agg(F.percentile_approx("doc_id", [i / salts for i in range(1, salts)], 10 * salts)).first()[0]
        part = F.aggregate(F.lit(sorted(set(cuts))), F.lit(0), lambda n, c: n + (F.col("doc_id") > c).cast("int"))
        known = [r["seed"] for r in hot.select("seed").collect()]  # one in HOT_SEED seeds at most, so few at any size
        parted = seeds.withColumn("hot", F.col("seed").isin(known)).withColumn("part", F.when(F.col("hot"), part).otherwise(0))
        near = linked(parted, "seed", "part")
        ends = parted.filter("hot").groupBy("seed", "part").agg(first.alias("f"), last.alias("l"))
        before = Window.partitionBy("seed").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        ends = stored(ends.select("seed", "part", F.min("f").over(before).alias("f"), F.max("l").over(before).alias("l")).filter("f is not null"), "hot-ends")
        rows = near.join(broadcast_if_small(ends, row_bytes=64), ["seed", "part"], "left").withColumn("first", F.coalesce("f", "first")).withColumn("last", F.coalesce("last", "l"))
    rows = rows.filter("first is not null").withColumn("last", F.struct(F.col("last.doc_id").alias("doc_id"), (-F.col("last.back")).alias("place")))
    rows = rows.select("doc_id", "place", F.explode(F.array_distinct(F.array("first", "last"))).alias("from"))
    return rows.select("doc_id", F.col("from.doc_id").alias("src"), "place", F.col("from.place").alias("src_place"))


def beside(here: np.ndarray, reach: int) -> np.ndarray:
    """Which links of a document have another link, at another place, within reach words."""
    places = np.unique(here)
    close = np.diff(places) <= reach
    return (np.append(close, False) | np.append(False, close))[np.searchsorted(places, here)]


def together(alone: np.ndarray, srcs: np.ndarray, here: np.ndarray, there: np.ndarray, covers: list[np.ndarray], k: int, reach: int) -> list[np.ndarray]:
    """Single links as few requests: without those inside what chains cover, neighbours with near places in one source joined."""
    if sum(x.size for x in covers) and len(alone):
        lo, hi = np.concatenate(covers, axis=1)
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order])
        at = np.searchsorted(lo, here[alone], side="right") - 1
        alone = alone[(at < 0) | (hi[at] < here[alone] + k)]
    out: list[list[int]] = []
    for x in alone.tolist():
        last = out[-1] if out else None
        if last and srcs[last[0]] == srcs[x] and here[x] - here[last[-1]] <= reach and abs(there[x] - there[last[0]]) <= SPREAD:
            last.append(x)
        else:
            out.append([x])
    return [np.array(x) for x in out]


def _chains(links: DataFrame, k: int, w: int) -> DataFrame:
    """Chains as requests for words: ask (a number), task and slot (to bound lists), doc_id, lo, hi, src, src_lo, src_hi, and the places of its links on both sides."""
    held = links.repartition("doc_id").sortWithinPartitions("doc_id", "src", "place", "src_place")
    names = ["ask", "task", "slot", "doc_id", "lo", "hi", "src", "src_lo", "src_hi"]

    def requests(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        arrays = [pa.array(c, type=pa.int64()) for c in columns[: len(names)]] + [pa.array(c, type=pa.binary()) for c in columns[len(names) :]]
        return pa.RecordBatch.from_arrays(arrays, [*names, "links", "src_links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substrings")
        task, number, asked = TaskContext.get().partitionId(), 0, {}
        out: list[tuple] = []
        for group in grouped(batches, ["doc_id"]):
            doc_id, srcs = group.column("doc_id")[0].as_py(), group.column("src").to_numpy()
            every, froms = group.column("place").to_numpy().astype(np.int64), group.column("src_place").to_numpy().astype(np.int64)
            near = beside(every, k + w)
            cuts = [0, *(np.flatnonzero(srcs[1:] != srcs[:-1]) + 1).tolist(), len(srcs)]
            taken, alone, covers = [], [], []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j - i < LEAST_SEEDS and not near[i]:
                    continue
                for links in chain(every[i:j], froms[i:j]):
                    at = np.array(links) + i
                    if len(at) >= LEAST_SEEDS:
                        taken.append(at)
                        close = np.flatnonzero((np.diff(every[at]) <= k + w) & (np.diff(froms[at]) <= k + w))
                        covers.append(np.stack([every[at[close]], every[at[close + 1]] + k]))
                    elif near[at[0]]:
                        alone.append(int(at[0]))
            for at in taken + together(np.array(sorted(alone), dtype=np.int64), srcs, every, froms, covers, k, k + w):
                src, here, there = int(srcs[at[0]]), every[at], froms[at]
                asked[src] = asked.get(src, -1) + 1
                out.append(((task << 33) + number, task, asked[src] // ASKS, doc_id, int(here[0]), int(here[-1]) + k, src, int(there.min()), int(there.max()) + k, here.astype(np.int32).tobytes(), there.astype(np.int32).tobytes()))
                number += 1
                if len(out) > 5000:
                    yield requests(out)
                    out = []
            if len(asked) > 1_000_000:
                asked = {}
        if out:
            yield requests(out)

    return held.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", links binary, src_links binary")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names)


def _aligned(docs: DataFrame, chains: DataFrame, k: int) -> DataFrame:
    """Aligned stretches (doc_id, lo, hi, src, src_lo, src_hi, matched) of LEAST_PART words or more."""
    here = chains.select("ask", "task", F.lit(-1).cast("long").alias("slot"), F.col("doc_id").alias("own"), F.lit(0).alias("side"), "lo", "hi", "doc_id", "src", "links")
    there = chains.select("ask", "task", "slot", F.col("src").alias("own"), F.lit(1).alias("side"), F.col("src_lo").alias("lo"), F.col("src_hi").alias("hi"), "doc_id", "src", F.col("src_links").alias("links"))
    asks = here.unionAll(there).groupBy("own", "task", "slot").agg(F.collect_list(F.struct("ask", "side", "lo", "hi", "doc_id", "src", "links")).alias("asks"))
    asks = stored(asks, "asks").hint("merge")  # grows with the documents, so it is joined by shuffle at any size
    met = docs.filter("doc_id is not null and text is not null").select("doc_id", "text").join(asks, F.col("doc_id") == F.col("own")).select("text", "asks")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substrings")
        for batch in batches:
            for piece in slices(batch, "text"):
                words = words_of(piece.column("text"))
                short = (words.hashes >> np.uint64(32)).astype(np.uint32)
                rows: list[tuple] = []
                for t, asked in enumerate(piece.column("asks").to_pylist()):
                    own = short[words.first[t] : words.first[t + 1]]
                    for x in asked:
                        base = max(0, x["lo"] - MARGIN - RESYNC)
                        rows.append((x["ask"], x["side"], base, own[base : x["hi"] + MARGIN + RESYNC].tobytes(), x["links"], x["doc_id"], x["src"]))
                    if len(rows) > 2000:
                        yield fetched(rows)
                        rows = []
                if rows:
                    yield fetched(rows)

    def fetched(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["ask", "side", "base", "words", "links", "doc_id", "src"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substrings")
        out: list[tuple] = []
        names = ["doc_id", "lo", "hi", "src", "src_lo", "src_hi", "matched"]
        for group in grouped(batches, ["ask"]):
            rows = {x["side"]: x for x in group.to_pylist()}
            if len(rows) < 2:
                continue
            (a, here), (b, there) = ((np.frombuffer(rows[s]["words"], dtype=np.uint32), (np.frombuffer(rows[s]["links"], dtype=np.int32) - rows[s]["base"]).tolist()) for s in (0, 1))
            base, src_base = rows[0]["base"], rows[1]["base"]
            for lo, hi, src_lo, src_hi, matched in stretches(a, b, here, there, k):
                if hi - lo >= LEAST_PART:
                    out.append((rows[0]["doc_id"], base + lo, base + hi, rows[0]["src"], src_base + src_lo, src_base + src_hi, matched))
            if len(out) > 5000:
                yield _batch(out, names)
                out = []
        if out:
            yield _batch(out, names)

    words = met.mapInArrow(fetch, "ask long, side int, base long, words binary, links binary, doc_id long, src long").repartition("ask").sortWithinPartitions("ask", "side")
    return words.mapInArrow(align, "doc_id long, lo long, hi long, src long, src_lo long, src_hi long, matched long")


def _owned(docs: DataFrame, own: str) -> DataFrame:
    """docs with a column of this name: the doc_id, or null in rows whose text doesn't stand for it."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    hashes = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("least"), F.max(key).alias("most"))
    at, least = unused([*docs.columns, own], "at", "least")
    twice = stored(hashes.filter("least <> most").select(F.col("doc_id").alias(at), F.col("least").alias(least)), "twice")
    if not twice.limit(1).count():
        return docs.withColumn(own, F.col("doc_id"))
    met = docs.join(broadcast_if_small(twice), F.col("doc_id") == F.col(at), "left")
    return met.withColumn(own, F.when(F.col(at).isNull() | (key == F.col(least)), F.col("doc_id"))).drop(at, least)


def repeated_passages(docs: DataFrame, k: int = K, w: int = W, least_words: int = LEAST_WORDS) -> DataFrame:
    """Fuzzy passages of documents (doc_id, text) that an earlier document has too."""
    ship(docs.sparkSession)
    docs = _owned(docs.select("doc_id", "text"), "own").select(F.col("own").alias("doc_id"), "text")
    chains = stored(_chains(_links(docs, k, w), k, w), "chains")
    parts = _aligned(docs, chains, k)
    by_place = Window.partitionBy("doc_id").orderBy("lo", "hi")
    reach = F.max("hi").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    joined = parts.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("lo") + OVERLAP).cast("int"))
    joined = joined.withColumn("passage", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    longest = F.max(F.struct((F.col("hi") - F.col("lo")).alias("size"), (-F.col("src")).alias("order"), "src", "src_lo", "src_hi", "matched")).alias("best")
    whole = joined.groupBy("doc_id", "passage").agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word"), longest)
    whole = whole.withColumn("n_words", F.col("end_word") - F.col("start_word")).filter(F.col("n_words") >= least_words)
    return whole.select("doc_id", "start_word", "end_word", "n_words", F.col("best.src").alias("src_doc_id"), F.col("best.src_lo").alias("src_start_word"), F.col("best.src_hi").alias("src_end_word"), F.col("best.matched").alias("matched_words"))


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the passages cut out of `text` (and n_chars counted anew, where it is there); documents left without a word go."""
    ship(docs.sparkSession)
    names = docs.columns
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    own, of, held = unused(names, "own", "of", "spans")
    spans = passages.groupBy(F.col("doc_id").alias(of)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(held))
    spans = broadcast_if_small(stored(spans, "spans"), row_bytes=96)
    met = _owned(docs, own).join(spans, F.col(own) == F.col(of), "left").drop(own, of)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substrings")
        for batch in batches:
            for piece in slices(batch, "text"):
                words = words_of(piece.column("text"))
                texts, keep = piece.column("text").to_pylist(), []
                for t, spans in enumerate(piece.column(held).to_pylist()):
                    if spans:
                        raw, at, first = words.data[words.text_at[t] : words.text_at[t + 1]].tobytes(), words.text_at[t], words.first[t]
                        left, last, count = [], 0, words.first[t + 1] - first
                        for x in spans:
                            lo, hi = x["start_word"], min(x["end_word"], count)
                            if lo >= hi:
                                continue
                            count_from = int(words.begin[first + lo] - at)
                            left.append(raw[last:count_from])
                            last = int(words.end[first + hi - 1] - at)
                        left.append(raw[last:])
                        parts = [left[0].strip(), *(x.lstrip(LOOSE).rstrip() for x in left[1:])]
                        texts[t] = b"\n".join(x for x in parts if x.strip(LOOSE)).decode("utf-8", "ignore")
                        gone = sum(max(0, min(x["end_word"], count) - x["start_word"]) for x in spans)
                        keep.append(gone < count)
                    else:
                        keep.append(True)
                columns = []
                for name in names:
                    column = piece.column(name)
                    if name == "text":
                        column = pa.array(texts, type=column.type)
                    elif name == "n_chars":
                        column = pa.array([None if x is None else len(x) for x in texts], type=column.type)
                    columns.append(column)
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, type=pa.bool_()))

    return met.mapInArrow(cut, ", ".join(f"`{n}` {kinds[n]}" for n in names))
