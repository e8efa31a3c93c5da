"""Two-level deduplication of passages with an explicit order column `ord`.

Winners are whole rows found by aggregation, which is combined before the shuffle: a text that a third
of all rows share leaves one row a task, and no input is read twice.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import broadcast_if_small, scratch, ship, stored
from ..functions.ids import fingerprint
from ..sources.vector_store import file_system, read_text, write_text


def fingerprint_of() -> Column:
    return fingerprint(F.col("target_lang"), F.col("translated_passage"), F.col("english_passage"))


def by_identity(rows: DataFrame) -> DataFrame:
    """The first row of each document_id."""
    return _winners(rows, F.col("document_id"), F.col("ord")).select("row.*")


def _winners(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """Per key the row that is least in order, and the least `ord`."""
    return rows.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*rows.columns), order).alias("row"), F.min("ord").alias("place"))


def content_groups(rows: DataFrame) -> DataFrame:
    """Per fingerprint: fp, rows n, first_ord, first_flag, first_selected (order of the first selected row), selected rows."""
    keyed = rows.select(fingerprint_of().alias("fp"), "ord", "is_selected")
    return keyed.groupBy("fp").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ord").alias("first_ord"),
        F.min_by("is_selected", "ord").alias("first_flag"),
        F.min(F.when(F.col("is_selected"), F.col("ord"))).alias("first_selected"),
        F.count_if("is_selected").alias("selected"),
    )


def by_content(rows: DataFrame, prefer_selected: bool = True) -> DataFrame:
    """One row per fingerprint: the first selected one if wanted and there, else the first; `place` is the group's first order."""
    order = F.struct(~F.col("is_selected"), F.col("ord")) if prefer_selected else F.col("ord")
    return _winners(rows, fingerprint_of(), order).select("row.*", "place")


def conflicts(rows: DataFrame, prefer_selected: bool = True) -> DataFrame:
    """Relevance conflicts per fingerprint with two rows or more: fp, n, conflicts."""
    groups = content_groups(rows)
    if prefer_selected:
        late = rows.select(fingerprint_of().alias("fp"), "ord", "is_selected").join(groups.select("fp", "first_selected"), "fp")
        late = late.filter(~F.col("is_selected") & (F.col("ord") > F.col("first_selected"))).groupBy("fp").agg(F.count(F.lit(1)).alias("late"))
        number = F.when(~F.col("first_flag") & (F.col("selected") > 0), 1).otherwise(0) + F.coalesce("late", F.lit(0))
        groups = groups.join(late, "fp", "left")
    else:
        number = F.when(F.col("first_flag"), F.col("n") - F.col("selected")).otherwise(F.col("selected"))
    return groups.filter("n > 1").select("fp", "n", number.cast("long").alias("conflicts"))


COUNTERS = ["processed", "kept", "identity_duplicates", "content_duplicates", "conflicts"]


@dataclass(frozen=True)
class Judged:
    """kept (document_id, fp, ord, flag) of a batch; events (fp, flag): contents that are new, and those whose flag turned true; counters."""

    kept: DataFrame
    events: DataFrame
    counters: dict[str, int]


def judge(rows: DataFrame, ids: DataFrame, contents: DataFrame, prefer_selected: bool = True) -> Judged:
    """What a batch (document_id, fp, ord, flag) comes to after the ids and contents (fp, flag) kept before it; those of the batch's own keys suffice."""
    open_rows = rows.join(ids, "document_id", "left_anti").join(contents, "fp", "left_anti")
    kept, size = None, 0
    while True:  # rows that come first both by id and by content are kept and rule others out; the rest goes on
        first_id = open_rows.groupBy("document_id").agg(F.min("ord").alias("by_id"))
        first_fp = open_rows.groupBy("fp").agg(F.min("ord").alias("by_fp"))
        now = stored(open_rows.join(first_id, "document_id").join(first_fp, "fp").filter("ord = by_id AND ord = by_fp").select("document_id", "fp", "ord", "flag"), "dedup-kept")
        number = now.count()
        if not number:
            break
        kept, size = now if kept is None else kept.unionAll(now), size + number
        open_rows = stored(open_rows.join(now.select("document_id"), "document_id", "left_anti").join(now.select("fp"), "fp", "left_anti"), "dedup-open")
    kept = kept if kept is not None else rows.limit(0).select("document_id", "fp", "ord", "flag")
    known = ids.select("document_id", F.lit(None).cast("long").alias("since")).unionAll(kept.select("document_id", F.col("ord").cast("long")))
    dropped = rows.join(kept.select("document_id", "ord"), ["document_id", "ord"], "left_anti")
    again = known.withColumnRenamed("document_id", "known_id")
    twice = F.col("known_id").isNotNull() & (F.col("since").isNull() | (F.col("since") < F.col("ord")))
    content = stored(dropped.join(again, F.col("document_id") == F.col("known_id"), "left").withColumn("twice", F.coalesce(twice, F.lit(False))).filter("NOT twice").select("fp", "ord", "flag"), "dedup-content")
    held = contents.select("fp", "flag", F.lit(False).alias("new")).unionAll(kept.select("fp", "flag", F.lit(True)))
    groups = content.groupBy("fp").agg(F.min(F.when(F.col("flag"), F.col("ord"))).alias("first_selected")).withColumnRenamed("fp", "group")
    state = stored(held.join(groups, F.col("fp") == F.col("group"), "left").select("fp", "flag", "new", "first_selected"), "dedup-state")
    met = content.withColumnRenamed("flag", "own").join(state, "fp")
    if prefer_selected:
        differs = F.when(F.col("flag") | (F.col("ord") > F.col("first_selected")), ~F.col("own")).otherwise(F.col("own"))
    else:
        differs = F.col("own") != F.col("flag")
    found = met.agg(F.count(F.lit(1)).alias("n"), F.count_if(differs).alias("conflicts")).first()
    total = rows.count()
    turned = F.col("first_selected").isNotNull() & F.lit(prefer_selected)
    events = state.filter(F.col("new") | (turned & ~F.col("flag"))).select("fp", (F.col("flag") | turned).alias("flag"))
    return Judged(kept, events, dict(zip(COUNTERS, (total, size, total - size - found["n"], found["n"], found["conflicts"]), strict=True)))


def _rows_of(batch: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of a batch with the (document_id, ord) that are kept. Where that takes a shuffle, an English passage that equals the translated one isn't sent, and the texts aren't sorted. Rows before the first and behind the last that is kept need no join."""
    ends = kept.agg(F.min("ord").alias("first"), F.max("ord").alias("last")).first()
    if ends["first"] is not None:
        batch = batch.filter(F.col("ord").between(ends["first"], ends["last"]))
    winners = broadcast_if_small(kept, row_bytes=128)
    if winners is not kept:
        return batch.join(winners, ["document_id", "ord"], "left_semi").select(*batch.columns)
    english, same = F.col("english_passage"), F.col("english_passage").eqNullSafe(F.col("translated_passage"))
    sent = batch.withColumns({"__same": same, "english_passage": F.when(~same, english)})
    met = sent.join(kept.hint("shuffle_hash"), ["document_id", "ord"], "left_semi")
    return met.withColumn("english_passage", F.when(F.col("__same"), F.col("translated_passage")).otherwise(english)).select(*batch.columns)


#: Bits a key and hash functions of the log's Bloom filters: about one key in a hundred looks known that isn't.
BLOOM_BITS, BLOOM_HASHES = 10, 5


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """keys x BLOOM_HASHES bit numbers of 64-bit hashes."""
    low, high = hashes.astype(np.uint64) & np.uint64(0xFFFFFFFF), hashes.astype(np.uint64) >> np.uint64(32)
    return ((low[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * (high[:, None] | np.uint64(1))) % np.uint64(bits)).astype(np.int64)


def _filter_of(rows: pa.Table) -> pa.Table:
    """The Bloom filter of a bucket's keys."""
    hashes = rows["hash"].to_numpy()
    bits = max(64, BLOOM_BITS * len(hashes))
    held = np.zeros(bits, dtype=np.uint8)
    held[_places(hashes, bits)] = 1
    return pa.table({"bucket": rows["bucket"][:1].cast(pa.int32()), "bits": pa.array([bits], pa.int64()), "held": pa.array([np.packbits(held).tobytes()], pa.binary())})


def _maybe_known(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Those keys of a bucket that a filter of it holds, or seems to."""
    hashes = keys["hash"].to_numpy()
    found = np.zeros(len(hashes), dtype=bool)
    for bits, held in zip(filters["bits"].to_pylist(), filters["held"].to_pylist(), strict=True):
        at = _places(hashes, bits)
        packed = np.frombuffer(held, dtype=np.uint8)
        found |= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)
    return keys.select(["key", "bucket"]).filter(pa.array(found))


class DedupLog:
    """Ids and contents kept so far, as a log that only grows: a batch writes what is new, whatever the history's size.

    root/batches/<n>/{ids, contents, filters, kept}, with keys in buckets by hash and a Bloom filter for each bucket; root/done/<n>.json, with
    the batch's counters, appears last, by a rename. A batch that is run again after a failure begins anew, one that
    is done isn't run again. A batch reads the filters, then of the history only the buckets in which one of its keys seems
    known. compact() puts the batches together into root/bases/<id>, where a content has one row again.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, prefer_selected: bool = True):
        self.spark, self.root, self.buckets, self.prefer_selected = spark, root.rstrip("/"), buckets, prefer_selected

    def _json(self, folder: str) -> dict[int, dict]:
        fs, at, _ = file_system(self.spark, f"{self.root}/{folder}")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        numbers = sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())
        return {n: json.loads(read_text(self.spark, f"{self.root}/{folder}/{n}.json")) for n in numbers}

    def done(self) -> dict[int, dict]:
        """Counters of the batches that are done, by number."""
        return self._json("done")

    def statistics(self) -> dict[str, int]:
        done = self.done().values()
        return {c: sum(x[c] for x in done) for c in COUNTERS}

    def _folders(self) -> list[str]:
        bases = self._json("base")
        base = bases[max(bases)] if bases else {"home": None, "batches": []}
        return ([base["home"]] if base["home"] else []) + [f"{self.root}/batches/{n}" for n in self.done() if n not in base["batches"]]

    def _read(self, what: str, schema: str) -> DataFrame:
        """A table of all folders; a schema has to name the bucket, by which ids and contents have folders of their own unless there is no row."""
        parts = [self.spark.read.schema(schema).parquet(f"{x}/{what}") for x in self._folders()]
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], schema)

    def _keyed(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn("hash", F.xxhash64(key)).withColumn("bucket", F.pmod("hash", F.lit(self.buckets)).cast("int"))

    def _known(self, rows: DataFrame, what: str, key: str, schema: str) -> DataFrame:
        """Rows of the log whose key a batch has: filters first, then the buckets that are left."""
        keys = self._keyed(rows.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct(), "key")
        filters = self._read(f"filters/{what}", "bucket int, bits long, held binary")
        maybe = stored(keys.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_maybe_known, "key string, bucket int"), "maybe-known")
        wanted = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # the log's buckets at most
        history = self._read(what, f"{schema}, bucket int").filter(F.col("bucket").isin(wanted) if wanted else F.lit(False))
        return history.join(maybe.select(F.col("key").alias(key)), key, "left_semi").drop("bucket")

    def _write(self, rows: DataFrame, home: str, what: str, key: str) -> None:
        placed = stored(self._keyed(rows, key), "dedup-new")
        placed.drop("hash").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/{what}")
        placed.groupBy("bucket").applyInArrow(_filter_of, "bucket int, bits long, held binary").write.mode("overwrite").parquet(f"{home}/filters/{what}")

    def process(self, batch: DataFrame, number: int) -> DataFrame:
        """The rows of batch `number` that are kept, with all their columns, as stored; `ord` orders rows within a batch."""
        ship(self.spark)
        home = f"{self.root}/batches/{number}"
        if number not in self.done():
            rows = stored(batch.select("document_id", fingerprint_of().alias("fp"), "ord", F.coalesce("is_selected", F.lit(False)).alias("flag")), "dedup-batch")
            ids = stored(self._known(rows, "ids", "document_id", "document_id string"), "known-ids")
            contents = stored(self._known(rows, "contents", "fp", "fp string, flag boolean").groupBy("fp").agg(F.max("flag").alias("flag")), "known-contents")
            found = judge(rows, ids, contents, self.prefer_selected)
            _rows_of(batch, found.kept.select("document_id", "ord")).write.mode("overwrite").option("compression", "zstd").parquet(f"{home}/kept")
            self._write(found.kept.select("document_id"), home, "ids", "document_id")
            self._write(found.events, home, "contents", "fp")
            write_text(self.spark, f"{self.root}/done/{number}.json", json.dumps(found.counters))
        return self.spark.read.schema(batch.schema).parquet(f"{home}/kept")

    def contents(self) -> DataFrame:
        """(fp, flag) of all contents kept."""
        return self._read("contents", "fp string, flag boolean, bucket int").groupBy("fp").agg(F.max("flag").alias("flag"))

    def compact(self) -> None:
        """Put all batches that are done into one base. Their kept rows stay where they are; what they hold of ids, contents and filters isn't read any more."""
        done, home = list(self.done()), f"{self.root}/bases/{uuid.uuid4().hex}"
        self._write(self._read("ids", "document_id string, bucket int").select("document_id").distinct(), home, "ids", "document_id")
        self._write(self.contents(), home, "contents", "fp")
        write_text(self.spark, f"{self.root}/base/{len(self._json('base'))}.json", json.dumps({"home": home, "batches": done}))


@dataclass
class IncrementalDedup:
    """Deduplication over batches: a row is dropped if its id is that of a row kept before it, or else its content.

    What is kept stays kept; a later selected row of the same content only turns the content's flag. The state is a
    DedupLog in a scratch folder; `ord` orders rows within a batch.
    """

    prefer_selected: bool = True
    log: DedupLog | None = None
    statistics: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))

    def process(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch that are kept, with all their columns."""
        spark = batch.sparkSession
        self.log = self.log or DedupLog(spark, scratch(spark, "dedup-log"), prefer_selected=self.prefer_selected)
        kept = self.log.process(batch, len(self.log.done()))
        self.statistics = self.log.statistics()
        return kept

    @property
    def contents(self) -> DataFrame | None:
        """(fp, flag) of all contents kept so far."""
        return self.log.contents() if self.log else None

    def reset(self) -> None:
        self.log = None
        self.statistics = dict.fromkeys(COUNTERS, 0)


def incremental(rows: DataFrame) -> DataFrame:
    """What a run over batches keeps of one batch: flags can't be retracted, so always the first row."""
    return IncrementalDedup().process(rows)
