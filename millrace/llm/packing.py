"""Operator 6, sum-of-squares online packing of documents into token windows.

Each task keeps a level array N: N[h] open windows that hold h tokens. A document (or what is left of
it after whole windows are cut off) goes to the level h for which the sum of N[h]^2 over partly
filled levels ends smallest, a new window counting as level 0; ties go to the fullest. When more
than `most_open` windows are open, and when the task ends, the emptiest windows are poured into the
gaps of the fullest ones, cutting documents there. The single window left at the end is cut into
windows of a power of two, which need no padding.

Memory: at most `most_open` windows of ids a task (1,024 unless said otherwise, 16 MB); beyond them the emptiest
are poured, so nothing is dropped. No shuffle: tasks pack the rows of their own input split. Defined cases: a
null or empty text is the end id alone; repeated rows and null ids are packed like others; a very long text
is cut into whole windows, its rest placed like a document; an empty table gives no row; columns other than
doc_id (a whole number) and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..cluster import ship
from .memory import enter
from .tokens import default_vocabulary, encoder
from .words import slices

WINDOW = 4096
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


@dataclass
class Window:
    pieces: list[Piece] = field(default_factory=list)
    fill: int = 0

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece.ids)


class Packer:
    """Closed windows go to `done`; levels[h] has the open windows that hold h tokens, counts[h] their number."""

    def __init__(self, size: int = WINDOW, most_open: int = 1024):
        self.size, self.most_open = size, most_open
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.levels: dict[int, list[Window]] = {}
        self.open = 0
        self.done: list[Window] = []

    def add(self, piece: Piece) -> None:
        while len(piece.ids) > self.size:
            head, piece = piece.cut(self.size)
            self.done.append(Window([head], self.size))
        n = len(piece.ids)
        if n == self.size:
            self.done.append(Window([piece], n))
            return
        window = self._take(self._best(n)) or Window()
        window.put(piece)
        self._give(window)
        if self.open > self.most_open:
            self._pour(self.most_open // 2)

    def _best(self, n: int) -> int:
        """The level whose choice makes the sum of squares smallest; 0 is a new window."""
        c, top = self.counts, self.size - n
        change = 2 * (c[n : self.size + 1] - c[: top + 1]) + 2
        change[0] = 2 * c[n] + 1
        change[top] = 1 - 2 * c[top] if top else change[top]
        change[1:][c[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def _take(self, level: int) -> Window | None:
        if not level:
            return None
        own = self.levels[level]
        window = own.pop()
        if not own:
            del self.levels[level]
        self.counts[level] -= 1
        self.open -= 1
        return window

    def _give(self, window: Window) -> None:
        if window.fill == self.size:
            self.done.append(window)
            return
        self.levels.setdefault(window.fill, []).append(window)
        self.counts[window.fill] += 1
        self.open += 1

    def _pour(self, keep: int) -> None:
        """Pour the emptiest windows into the fullest until at most `keep` are open."""
        held = sorted((w for own in self.levels.values() for w in own), key=lambda w: w.fill)
        low, high = 0, len(held) - 1
        while high - low + 1 > keep and low < high:
            source, target = held[low], held[high]
            piece, gap = source.pieces.pop(), self.size - target.fill
            if len(piece.ids) > gap:
                piece, rest = piece.cut(gap)
                source.pieces.append(rest)
            source.fill -= len(piece.ids)
            target.put(piece)
            if target.fill == self.size:
                self.done.append(target)
                high -= 1
            low += not source.pieces
        self.levels, self.open = {}, 0
        self.counts[:] = 0
        for window in held[low : high + 1]:
            self._give(window)

    def finish(self) -> None:
        self._pour(1)
        for window in [w for own in self.levels.values() for w in own]:
            pieces = window.pieces[::-1]
            for bit in reversed(range(window.fill.bit_length())):
                if window.fill >> bit & 1:
                    part = Window()
                    while part.fill < 1 << bit:
                        piece = pieces.pop()
                        if len(piece.ids) > (1 << bit) - part.fill:
                            piece, rest = piece.cut((1 << bit) - part.fill)
                            pieces.append(rest)
                        part.put(piece)
                    self.done.append(part)
        self.levels, self.open = {}, 0
        self.counts[:] = 0


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of documents (doc_id, text) by sequence; with_ids adds the ids themselves as `ids` array<int>.

    sequence_id is the input split's number times 2^32 plus a count, so a task that is run again names
    its sequences alike.
    """
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        packer, number = Packer(size), TaskContext.get().partitionId() << 32

        def drain() -> pa.RecordBatch:
            nonlocal number
            rows, ids = [], []
            for window in packer.done:
                offset = 0
                for p in window.pieces:
                    rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.doc_tokens, number, offset))
                    ids.append(p.ids)
                    offset += len(p.ids)
                number += 1
            packer.done = []
            columns = [pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], type=pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for piece in slices(batch, "text", 3 << 20):
                ids, bounds = encoder(path).encode(piece.column("text"))
                whole = np.insert(ids, bounds[1:], end_id).astype("<u4")
                at = bounds + np.arange(len(bounds))
                for i, doc_id in enumerate(piece.column("doc_id").to_pylist()):
                    own = whole[at[i] : at[i + 1]].copy()  # not a view, which would hold the whole slice
                    packer.add(Piece(doc_id, 0, own, len(own)))
                if packer.done:
                    yield drain()
        packer.finish()
        if packer.done:
            yield drain()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
