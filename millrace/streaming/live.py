"""Structured Streaming forms: deduplication, latency counters, breaker, windows over event time."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..cluster import scratch, ship, stored
from ..operators.dedup import DedupLog, fingerprint_of
from ..sources.vector_store import VectorStore


def dedup(passages: DataFrame) -> DataFrame:
    """The first row of each content fingerprint; state grows with the distinct contents."""
    return passages.withColumn("fp", fingerprint_of()).dropDuplicates(["fp"])


def dedup_into(passages: DataFrame, log: DedupLog) -> DataFrame:
    """Deduplicate a stream of passages on both levels, with the log as state; runs over what is there now. Returns the kept rows of all micro-batches with their number, `batch`.

    The checkpoint is a folder of the log, so a later call goes on; a micro-batch that is run again counts once.
    """

    def put(df: DataFrame, number: int) -> None:
        log.process(stored(df, "micro-batch"), number)

    query = passages.writeStream.option("checkpointLocation", f"{log.root}/stream").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    parts = [passages.sparkSession.read.schema(passages.schema).parquet(f"{log.root}/batches/{n}/kept").withColumn("batch", F.lit(n)) for n in log.done()]
    return reduce(DataFrame.unionAll, parts) if parts else passages.sparkSession.createDataFrame([], passages.schema).withColumn("batch", F.lit(0))


def latency(samples: DataFrame) -> DataFrame:
    """Running counters per stage of (stage, ms); update or complete mode."""
    return samples.groupBy("stage").agg(F.count("ms").alias("n"), F.sum("ms").alias("total"), F.min("ms").alias("least"), F.max("ms").alias("most"))


#: State of the processors below lives in RocksDB; Spark's setting and the provider that keeps it on the executors' heap.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _with_state(rows: DataFrame) -> None:
    """What a query with a processor needs. Spark also runs processors in a worker beside the driver, which gets no shipped code, so they are pickled whole."""
    ship(rows.sparkSession)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows.sparkSession.conf.set(*STATE_STORE)


def _tail(pool: pd.DataFrame | None, more: pd.DataFrame, last: int) -> pd.DataFrame:
    """The `last` rows of greatest seq of both, in order."""
    whole = more if pool is None else pd.concat([pool, more], ignore_index=True)
    return whole.sort_values("seq", kind="stable").tail(last)


def last_of_task(last: int) -> Callable:
    """Of each stage's samples in a task, the `last` ones: all that its recorder can need."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, pd.DataFrame] = {}
        for frame in frames:
            for stage, part in frame.groupby("stage", dropna=False, sort=False):
                held[stage] = _tail(held.get(stage), part, last)
        yield from held.values()

    return run


class Recorder(StatefulProcessor):
    """A stage's last samples as list state, and their percentiles after each micro-batch."""

    def __init__(self, last: int):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getListState("values", "ms double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        pool = None
        for frame in rows:
            pool = _tail(pool, frame[["seq", "ms"]], self.last)
        held = ([v for (v,) in self.values.get()] + pool["ms"].tolist())[-self.last :]
        self.values.put([(float(v),) for v in held])
        p50, p70, p100 = np.percentile(held, [50, 70, 100])
        yield pd.DataFrame({"stage": [key[0]], "n": [len(held)], "p50": [p50], "p70": [p70], "p100": [p100]})

    def close(self) -> None:
        pass


def recent_percentiles(samples: DataFrame, last: int = 500) -> DataFrame:
    """P50, P70 and P100 of the last samples per stage of (stage, seq, ms), after each micro-batch.

    Each task hands on a stage's last samples of its part only, so a stage with any share of a micro-batch gives its recorder
    at most `last` rows a task; the state holds `last` values a stage.
    """
    _with_state(samples)
    kept = samples.filter("ms IS NOT NULL").select("stage", F.col("seq").cast("long").alias("seq"), F.col("ms").cast("double").alias("ms"))
    parts = kept.mapInPandas(last_of_task(last), "stage string, seq long, ms double")
    return parts.groupBy("stage").transformWithStateInPandas(Recorder(last), "stage string, n long, p50 double, p70 double, p100 double", "update", "None")


class Outcomes:
    """What outcomes in any order come to: the last success, and the failures behind it."""

    def __init__(self):
        self.success, self.failed = None, []

    def add(self, seq: np.ndarray, ok: np.ndarray) -> None:
        if ok.any():
            self.success = max(seq[ok].max(), self.success if self.success is not None else seq[ok].max())
        self.failed.append(seq[~ok])
        if len(self.failed) > 64:
            self.failed = [self.behind()]

    def behind(self) -> np.ndarray:
        """Failures after the last success."""
        seq = np.concatenate(self.failed) if self.failed else np.zeros(0, dtype=np.int64)
        return seq if self.success is None else seq[seq > self.success]


def outcomes_of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each key's outcomes in a task the last success and the failures behind it: all that its breaker can need."""
    held: dict[str, Outcomes] = {}
    for frame in frames:
        for key, part in frame.groupby("key", dropna=False, sort=False):
            held.setdefault(key, Outcomes()).add(part["seq"].to_numpy(), part["ok"].to_numpy(dtype=bool))
    for key, found in held.items():
        behind = found.behind()
        seq = behind if found.success is None else np.concatenate([[found.success], behind])
        ok = np.zeros(len(seq), dtype=bool)
        ok[: int(found.success is not None)] = True
        yield pd.DataFrame({"key": [key] * len(seq), "seq": seq.astype(np.int64), "ok": ok})


class Breaker(StatefulProcessor):
    """A key's failures in a row and whether it is open; a timer makes an open one half open."""

    def __init__(self, failures: int, recovery: float | None):
        self.failures, self.recovery = failures, recovery

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "in_a_row long, opened boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        count, opened = self.state.get() if self.state.exists() else (0, False)
        found = Outcomes()
        for frame in rows:
            found.add(frame["seq"].to_numpy(), frame["ok"].to_numpy(dtype=bool))
        if found.success is not None:
            count, opened = 0, False
        count += len(found.behind())
        opened = bool(opened or count >= self.failures)
        self.state.update((int(count), opened))
        if self.recovery is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if opened:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, int(self.recovery * 1000)))
        yield pd.DataFrame({"key": [key[0]], "in_a_row": [int(count)], "state": ["open" if opened else "closed"]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"key": [key[0]], "in_a_row": [int(self.state.get()[0])], "state": ["half_open"]})

    def close(self) -> None:
        pass


def breaker(outcomes: DataFrame, failures: int = 3, recovery: float | None = 30.0) -> DataFrame:
    """State per key of (key, seq, ok) after each micro-batch; an open one is half open once `recovery` seconds passed without an outcome.

    Each task hands on a key's last success and the failures behind it only; the state is two values a key.
    The timer keeps a query going, so runs over what is there now (drain) pass None: no recovery.
    """
    _with_state(outcomes)
    parts = outcomes.select("key", F.col("seq").cast("long").alias("seq"), "ok").filter("seq IS NOT NULL AND ok IS NOT NULL").mapInPandas(outcomes_of_task, "key string, seq long, ok boolean")
    return parts.groupBy("key").transformWithStateInPandas(Breaker(failures, recovery), "key string, in_a_row long, state string", "update", "None" if recovery is None else "ProcessingTime")


def append_to_index(vectors: DataFrame, store: VectorStore, *order: str, chunks: list[str] | None = None, name: str = "vectors") -> None:
    """Append a stream of vectors (chunk_id, embedding, further columns) to a store that is there, a micro-batch at a time; `chunks` names the columns of its chunk table. Runs over what is there now.

    The stream's checkpoint is a folder of the store, by name, so a later call goes on where this one ended. A
    batch that is run again after a failure is appended once: the manifest has the query's id and the number of its last batch.
    """

    def put(df: DataFrame, number: int) -> None:
        own, batch = stored(df, "batch"), (df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), number)
        if own.isEmpty() or store.appended(*batch):
            return
        names = chunks or []
        store.append(own.drop(*[c for c in names if c != "chunk_id"]), *order, chunks=own.select(*names) if names else None, batch=batch)

    query = vectors.writeStream.option("checkpointLocation", f"{store.root}/streams/{name}").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()


class Progress(StreamingQueryListener):
    """Tells a function what each micro-batch did: query, batch, rows and the metrics observed in it by name. What the function raises is ignored."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with contextlib.suppress(Exception):
            self.tell({"query": p.name, "batch": p.batchId, "rows": p.numInputRows, "observed": {name: row.asDict() for name, row in p.observedMetrics.items()}})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def report_progress(spark: SparkSession, tell: Callable[[dict], None]) -> Progress:
    """Report on all streams of a session from now on; spark.streams.removeListener ends it."""
    listener = Progress(tell)
    spark.streams.addListener(listener)
    return listener


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of (ts, event_type, value) per overlapping window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of (ts, event_type, value) per window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per user_id: events closer than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def drain(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its output. update and complete rows are kept per batch in `batch`."""
    out, marks = scratch(spark, name), scratch(spark, f"{name}-marks")

    def put(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b{number:06d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(out)
