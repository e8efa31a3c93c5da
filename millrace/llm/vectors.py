"""Vectors of Arrow batches as numpy matrices, and rows that repeat an id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix in double precision) for each length of the lists in a column; rows with a null or non-finite component, and null ones, are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    there = column.is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[there]):
        rows = np.flatnonzero(there & (sizes == size))
        matrix = values if len(values) == len(rows) * size and len(rows) == len(sizes) else values[starts[rows][:, None] + np.arange(size)]
        matrix = matrix.reshape(len(rows), size)
        good = np.isfinite(matrix).all(axis=1)
        if good.any():
            yield rows[good], matrix[good]


def lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as lists of this type."""
    n, size = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(np.ascontiguousarray(matrix).reshape(-1), kind))


def rows_of(column: pa.Array, size: int) -> np.ndarray:
    """Lists of one length as a matrix; no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def one_per_id(rows: DataFrame, key: str, *others: str) -> DataFrame:
    """rows with an id, one of each: where an id is repeated, that with the least of the other columns, in their order, nulls first."""
    rows = rows.select(key, *others).filter(F.col(key).isNotNull())
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("ids")).first()
    if seen["n"] == seen["ids"]:
        return rows
    least = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("least"))
    return least.select(key, *[F.col(f"least.{c}").alias(c) for c in others])
