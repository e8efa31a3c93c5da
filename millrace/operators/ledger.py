"""A durable ledger of provider calls: each distinct request is called once, and its answer is kept.

Requests are keyed by SHA-256 and deduplicated; those that have an answer aren't called again, in this run or in a
later one. A task journals its answers every few calls, as a file that appears by a rename, so an attempt that follows a
killed one reads the journal first and calls only the rest. When all calls of a run are made, the
committer appends the journal to the table of answers, and the journal goes. Errors are told, but
aren't answers: a later run calls them again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import files
from ..cluster import scratch, ship, stored
from ..sources.vector_store import file_system

#: In a task: from requests to (answer by column, or None; error, or None), in their order.
Caller = Callable[[list], list[tuple[dict[str, Any] | None, str | None]]]


def request_id(given: Column) -> Column:
    return F.sha2(given.cast("binary"), 256)


def journaled(folder: str) -> set[str]:
    """Requests that have a row in the journal of a task."""
    return {r for uri in files.listed(folder) for r in pq.read_table(files.read(uri), columns=["request"])["request"].to_pylist()}


class Ledger:
    """root/<stage>/answers, the table of answers, and root/<stage>/run-<id>/<part>/, journals of runs. One ledger serves one provider and its settings; stages keep kinds of calls apart.

    every: calls between two entries of a journal, what an attempt that is killed costs at most. tasks: how many tasks call at once; by default twice the cores.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, every: int = 32, tasks: int | None = None):
        if every <= 0:
            raise ValueError("a journal needs a positive number of calls per entry")
        self.spark, self.root, self.every = spark, (root or scratch(spark, "ledger")).rstrip("/"), every
        self.tasks = tasks or 2 * spark.sparkContext.defaultParallelism

    def _there(self, path: str) -> bool:
        fs, at, _ = file_system(self.spark, path)
        return fs.exists(at)

    def _rows(self, stage: str, columns: dict[str, str]) -> DataFrame | None:
        """Rows of the table and of journals that a run left behind."""
        home = f"{self.root}/{stage}"
        if not self._there(home):
            return None
        return self.spark.read.schema(_ddl(columns)).option("recursiveFileLookup", "true").parquet(home)

    def answers(self, stage: str, columns: dict[str, str]) -> DataFrame | None:
        """(request, columns, error), one row a request: its first answer, or its last error."""
        rows = self._rows(stage, columns)
        if rows is None:
            return None
        failed = F.col("error").isNotNull()
        first = F.min_by(F.struct(*columns, "error"), F.struct(failed, F.when(failed, -F.col("at")).otherwise(F.col("at")), "attempt"))
        return rows.groupBy("request").agg(first.alias("row")).select("request", "row.*")

    def ask(self, stage: str, rows: DataFrame, key: str, given: str, columns: dict[str, str], make: Callable[[], Caller], every: int | None = None) -> DataFrame:
        """(key, columns, error) for rows (key, given): the ledger's answers, after a call for every request that has none. Calls are made here, not when the result is read."""
        ship(self.spark)
        asked = stored(rows.select(F.col(key).alias("key"), F.col(given).alias("given"), request_id(F.col(given)).alias("request")), "asked")
        waiting = asked.groupBy("request").agg(F.first("given").alias("given"))
        if (known := self.answers(stage, columns)) is not None:
            waiting = waiting.join(known.filter("error IS NULL").select("request"), "request", "left_anti")
        waiting = stored(waiting, "waiting")
        if number := waiting.count():
            self._call(stage, waiting, number, columns, make, every or self.every)
        told = self.answers(stage, columns)
        if told is None:  # nothing was ever asked
            return asked.select(F.col("key").alias(key), *[F.lit(None).cast(t).alias(n) for n, t in columns.items()], F.lit(None).cast("string").alias("error"))
        return asked.join(told, "request").select(F.col("key").alias(key), *columns, "error")

    def _call(self, stage: str, waiting: DataFrame, number: int, columns: dict[str, str], make: Callable[[], Caller], every: int) -> None:
        home, run = f"{self.root}/{stage}", f"{self.root}/{stage}/run-{uuid.uuid4().hex}"
        schema = to_arrow_schema(StructType.fromDDL(_ddl(columns)))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            folder, attempt = f"{run}/part-{TaskContext.get().partitionId()}", uuid.uuid4().hex
            done, call, held, entries, made = journaled(folder), None, [], 0, 0

            def flush() -> None:
                nonlocal call, entries, made
                call = call or make()
                found = call([x for _, x in held])
                rows = [{"request": r, **{c: (answer or {}).get(c) for c in columns}, "error": error, "at": time.time_ns(), "attempt": attempt} for (r, _), (answer, error) in zip(held, found, strict=True)]
                files.publish(f"{folder}/{attempt}-{entries}.parquet", lambda out: pq.write_table(pa.Table.from_pylist(rows, schema), out))
                entries, made = entries + 1, made + len(held)
                held.clear()

            for batch in batches:
                for request, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if request not in done:
                        held.append((request, given))
                    if len(held) == every:
                        flush()
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([pa.array([made])], names=["calls"])

        parts = min(self.tasks, -(-number // every))
        waiting.repartition(parts, "request").mapInArrow(work, "calls long").agg(F.sum("calls")).first()
        if self._there(run):
            self.spark.read.schema(_ddl(columns)).option("recursiveFileLookup", "true").parquet(run).write.mode("append").parquet(f"{home}/answers")
            fs, at, _ = file_system(self.spark, run)
            fs.delete(at, True)


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(["request string", *[f"`{n}` {t}" for n, t in columns.items()], "error string", "at long", "attempt string"])
