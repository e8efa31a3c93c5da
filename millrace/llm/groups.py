"""Sorted rows of a task as groups, whatever the Arrow batches they come in; names for columns beside those of a caller."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal keys; rows arrive sorted by keys. Holds one group and one batch."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        new = np.zeros(rows.num_rows, dtype=bool)
        for k in keys:
            column = batch.column(k)
            same = pc.equal(column.slice(1), column.slice(0, rows.num_rows - 1))
            same = pc.if_else(pc.is_null(same), pc.and_(pc.is_null(column.slice(1)), pc.is_null(column.slice(0, rows.num_rows - 1))), same)
            new[1:] |= ~np.asarray(same.to_numpy(zero_copy_only=False), dtype=bool)
        if held and any(held[-1].column(k)[-1].as_py() != rows.column(k)[0].as_py() for k in keys):
            yield pa.concat_tables(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist()]
        for i, j in zip(cuts, cuts[1:], strict=False):
            held.append(rows.slice(i, j - i))
            yield pa.concat_tables(held)
            held = []
        held.append(rows.slice(cuts[-1]))
    if held:
        yield pa.concat_tables(held)


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has, in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out
