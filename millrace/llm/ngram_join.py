"""Operator 3, n-gram Jaccard self-join by MinHash banding.

1. One pass over the texts gives each a MinHash signature of its n-word windows, hashed into bands.
   `choose_bands` picks bands and rows for the target recall at the threshold.
2. Equal texts are one node from here on. A shuffle on band hashes puts nodes into buckets; the links of
   a bucket's members to its least member join buckets into clusters of candidates.
3. Texts that share a band meet and are compared. In a cluster of at most MOST_PARTS blocks all texts
   meet once; larger clusters (chains of chance candidates can make huge ones) are taken apart into their
   buckets again, and a pair counts in the bucket of its first common band. Clusters and buckets are cut
   into blocks of bounded size and every pair of blocks is one group, in which the full n-gram sets are
   compared exactly by an incidence matrix. What leaves a group is one row per member (its number of
   links and the least member of its component in the group), never the pairs, so the rows grow with the members.
4. Components of the confirmed links are the classes.

A link is a pair of texts that share a band and have Jaccard >= threshold, at every size of cluster.

Per row: doc_id, class_id (least doc_id of the class), n_links (other texts with Jaccard >= threshold),
n_copies (rows with the same text, itself included).

Defined cases: a null text counts as empty; texts without words have no links but are copies of equal
ones; a text of less than n words has one window of all its words; null ids don't become a class_id
unless all of the class are null; repeated rows each keep their row; very long texts are read whole;
ties for the head of a class go to the least doc_id, then digest; an empty table gives no row; columns
other than doc_id (a whole number) and text aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import broadcast_if_small, ship, stored
from .graph import is_small, sized_components, with_totals
from .groups import grouped, unused
from .memory import enter
from .words import mix, shingles, slices, words_of

N = 5
THRESHOLD = 0.8
RECALL = 0.999
#: A block holds about this many windows and at most about this many texts.
BLOCK_WINDOWS, BLOCK_TEXTS = 400_000, 1_000
#: Clusters of more blocks are compared bucket by bucket.
MOST_PARTS = 8
DENSE_FROM = 16


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest chance candidates) whose bands reach recall at the threshold within `most` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _multipliers(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(hashes: np.ndarray, bounds: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """Band hashes, one line per text with windows."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), bands), dtype=np.uint64)
    if not len(starts):
        return out
    a = _multipliers(bands * rows, seed)
    buffer = np.empty_like(hashes)
    for k in range(bands * rows):
        np.multiply(hashes, a[k], out=buffer)
        least = np.minimum.reduceat(buffer, starts)
        band = k // rows
        out[:, band] = mix(out[:, band] * np.uint64(0x9E3779B97F4A7C15) + (least >> np.uint64(16)) + np.uint64(band + 1))
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, windows, bands): digest is the text's MD5, bands its band hashes (empty without words)."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngram")
        for batch in batches:
            for piece in slices(batch, "text"):
                hashes, bounds = shingles(words_of(piece.column("text")), n)
                number = np.diff(bounds)
                signed = band_hashes(hashes, bounds, bands, rows).astype(np.int64, copy=False).view(np.int64)
                at = np.concatenate(([0], np.cumsum(np.where(number > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(signed.reshape(-1)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("digest"), pa.array(number, type=pa.int64()), lists], ["doc_id", "digest", "windows", "bands"])

    return docs.select("doc_id", F.unhex(F.md5(text)).alias("digest"), text.alias("text")).mapInArrow(sign, "doc_id long, digest binary, windows long, bands array<long>")


def _compare(texts: pa.Array, bands: np.ndarray, band: int, side: np.ndarray, within: bool, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each text and the least text of its component, in one block or between two.

    bands: one line of band hashes a text. Links have a band in common: any (band -1), or this one as the first.
    """
    hashes, bounds = shingles(words_of(texts), n)
    count = len(bounds) - 1
    owner = np.repeat(np.arange(count), np.diff(bounds))
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    sizes = np.bincount(owner, minlength=count).astype(np.int64)
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    starts = np.flatnonzero(new)
    held = np.diff(np.append(starts, len(hashes)))
    common = np.zeros((count, count), dtype=np.float32)
    each = np.repeat(held, held)
    few = np.flatnonzero((each > 1) & (each <= DENSE_FROM))
    rank = np.arange(len(hashes)) - np.repeat(starts, held)
    for k in range(1, DENSE_FROM):
        first = few[rank[few] + k < each[few]]
        if not len(first):
            break
        pair = owner[first] * count + owner[first + k]
        common += np.bincount(pair, minlength=count * count).reshape(count, count)
    common += common.T
    many = np.flatnonzero(held > DENSE_FROM)
    for i in range(0, len(many), 2048):
        part = many[i : i + 2048]
        x = np.zeros((count, len(part)), dtype=np.float32)
        for c, s in enumerate(part):
            x[owner[starts[s] : starts[s] + held[s]], c] = 1
        common += x @ x.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = (common >= threshold * union - 1e-6) & (common > 0)
    np.fill_diagonal(linked, False)
    if not within:
        linked &= side[:, None] != side[None, :]
    one, two = np.nonzero(linked)
    for i in range(0, len(one), 50_000):
        a, b = one[i : i + 50_000], two[i : i + 50_000]
        common_bands = bands[a] == bands[b]
        counted = common_bands.any(axis=1) if band < 0 else ~common_bands[:, :band].any(axis=1)
        linked[a[~counted], b[~counted]] = False
    return linked.sum(axis=1).astype(np.int64), _roots(linked)


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each member's component in a symmetric matrix of links."""
    root = np.arange(len(linked))
    held = np.flatnonzero(linked.any(axis=1))
    links = linked[np.ix_(held, held)]
    label = np.arange(len(held))
    while len(held):
        near = np.where(links, label[None, :], len(held)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            break
        label = new
    root[held] = held[label]
    return root


def jaccard_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row of docs: doc_id, digest, class_id, class_digest, n_links, n_copies."""
    spark = docs.sparkSession
    ship(spark)
    bands, rows = choose_bands(threshold, recall)
    signed = stored(signatures(docs.select("doc_id", "text"), n, bands, rows), "signatures")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id"))).alias("first")
    nodes = stored(signed.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n_copies"), F.max("windows").alias("windows"), F.first("bands").alias("bands")), "nodes")

    buckets = nodes.select("digest", F.explode("bands").alias("h"))
    leads = buckets.groupBy("h").agg(F.min("digest").alias("lead"), F.count(F.lit(1)).alias("held")).filter("held > 1").select("h", "lead")
    leads = broadcast_if_small(stored(leads, "leads"), row_bytes=48)  # stored, so that both sides of a shuffle join can be split
    clusters, number = sized_components(buckets.join(leads, "h").filter("digest <> lead").select(F.col("digest").alias("a"), F.col("lead").alias("b")))
    members = stored(_members(nodes, clusters, number, bands), "members")
    marks = members.select(F.col("digest").alias("key"), "own")  # texts that are compared with none are left where they are, while the marks are few enough

    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    kept = texts.join(broadcast_if_small(marks, row_bytes=48), (F.col("digest") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("own")), "left_semi")
    met = kept.join(members.hint("merge"), "digest").withColumn("ask", F.explode("asks"))
    met = met.select("digest", "text", "bands", "ask.*").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest", "bands", "text")
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "digest")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngram")
        ready: list[pa.RecordBatch] = []
        waiting = 0
        for group in grouped(batches, ["key", "i", "j"]):
            group = group.combine_chunks()
            digests = group.column("digest").combine_chunks()
            if group.num_rows > 1:  # a row that is there twice counts once
                raw = digests.to_pylist()
                keep = [k for k in range(len(raw)) if not k or raw[k] != raw[k - 1]]
                if len(keep) < len(raw):
                    group = group.take(keep).combine_chunks()
                    digests = group.column("digest").combine_chunks()
            side = group.column("block").to_numpy()
            within = group.column("i")[0].as_py() == group.column("j")[0].as_py()
            held = np.asarray(group.column("bands").combine_chunks().flatten()).reshape(group.num_rows, -1)
            links, least = _compare(group.column("text"), held, group.column("band")[0].as_py(), side, within, n, threshold)
            ready.append(pa.RecordBatch.from_arrays([digests, digests.take(pa.array(least)), pa.array(links)], ["a", "b", "links"]))
            waiting += len(links)
            if waiting > 5000:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready, waiting = [], 0
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    confirmed = stored(met.mapInArrow(verify, "a binary, b binary, links long"), "confirmed")
    linked, number = sized_components(confirmed.select("a", "b"))
    headed = nodes.select("digest", "first").join(linked.withColumnRenamed("node", "digest"), "digest")
    headed = with_totals(headed if is_small(number) else stored(headed, "linked"), "root", "digest", number, head=(F.min(F.struct("first", "digest")), F.min("head"))).select("digest", "head")
    counts = confirmed.groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("n_links"))
    known = nodes.select("digest", "first", "n_copies").join(headed, "digest", "left").join(counts, "digest", "left").withColumn("head", F.coalesce("head", F.struct("first", "digest")))
    classes = known.select("digest", F.col("head.first.doc_id").alias("class_id"), F.col("head.digest").alias("class_digest"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    classes = stored(classes, "digest-classes")  # a text of very many copies then is a partition that Spark can split
    return signed.select("doc_id", "digest").join(classes, "digest").select("doc_id", "digest", "class_id", "class_digest", "n_links", "n_copies")


def _parts() -> Column:
    return F.greatest(F.ceil(F.col("windows_in") / BLOCK_WINDOWS), F.ceil(F.col("texts_in") / BLOCK_TEXTS)).cast("int")


def _members(nodes: DataFrame, clusters: DataFrame, number: int, bands: int) -> DataFrame:
    """(digest, own, bands, asks): the texts of clusters with the groups they are in; asks: of (key, band, parts, block)."""
    totals = {"windows_in": (F.sum("windows"), F.sum("windows_in")), "texts_in": (F.count(F.lit(1)), F.sum("texts_in"))}
    sized = nodes.select("digest", "windows", "bands", F.col("first.doc_id").alias("own")).join(clusters.withColumnRenamed("node", "digest"), "digest")
    sized = with_totals(sized if is_small(number) else stored(sized, "sized"), "root", "digest", number, **totals).withColumn("parts", _parts())
    sized = stored(sized.drop("windows_in", "texts_in"), "clusters")
    block = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
    ask = F.struct("key", "band", "parts", block.alias("block"))
    whole = sized.filter(F.col("parts") <= MOST_PARTS).withColumn("key", F.col("root")).withColumn("band", F.lit(-1))
    whole = whole.select("digest", "own", "bands", F.array(ask).alias("asks"))
    large = sized.filter(F.col("parts") > MOST_PARTS)
    if not (number := large.count()):
        return whole
    apart = large.select("digest", "windows", F.posexplode("bands").alias("band", "h")).withColumn("key", F.encode(F.concat_ws(":", F.lpad(F.hex("h"), 16, "0"), "band"), "utf-8"))
    apart = with_totals(apart, "key", "digest", bands * number, **totals).filter("texts_in > 1").withColumn("parts", _parts())
    apart = apart.groupBy("digest").agg(F.collect_list(ask).alias("asks"))  # one entry a band at most
    return whole.unionByName(large.select("digest", "own", "bands").join(apart, "digest"))


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs that head their class, one per class, with all their columns."""
    classes = stored(jaccard_classes(docs, n, threshold, recall).select("doc_id", "digest", "class_id", "class_digest"), "classes")
    heads = classes.filter((F.col("digest") == F.col("class_digest")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("held"))
    heads = stored(heads, "heads")
    names = docs.columns
    own, doc, key = unused(names, "own", "doc", "key")
    keyed = docs.withColumn(own, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    marks = heads.select(F.col("doc_id").alias(doc), F.col("digest").alias(key))
    kept = keyed.join(broadcast_if_small(marks, row_bytes=64), (F.col(own) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left_semi")
    if heads.filter("held > 1").limit(1).count():  # repeated rows only then cost a shuffle
        kept = kept.dropDuplicates(["doc_id", own])
    return kept.select(*names)
