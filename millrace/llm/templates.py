"""Operator 2, benchmark decontamination by template canonicalisation.

Texts become tokens of four types: literal words, and slots for numbers, names and units. A number is a
word of digits or a number word; a unit is one of UNITS after a number; a name is a capitalised word
(not all capitals) that doesn't begin a sentence. Neighbouring slots of one type are one slot. Windows
of n template tokens with enough literals are hashed and joined with those of the benchmark's items.
For each document and item the matched windows give the share of the item's windows that the document
has, and their slots are laid side by side: an item's slot value has to meet the same document value
wherever it occurs, and the reverse for names and units (numbers may become equal by chance), or the match
is a coincidence of phrasing. Windows that don't agree all together are judged by occurrence: those on
neighbouring diagonals (place in the document less place in the item), and those whose slots are the item's own.

Before the join a bit table of the items' window hashes, of a fixed number of bits per window up to
a fixed size, drops document windows that no item can have. It only saves shuffle: a full table lets
more rows through to the join, which decides.

Rows, one per contaminated (document, item): doc_id, item_id, n_windows, item_windows, coverage, n_slots,
slot_consistency, exact (all slot values are the item's own).

Defined cases: null and empty texts have no windows; a text or item of less than n tokens has one window
of all its tokens; repeated rows and null ids are judged as rows of their own; very long texts are read
whole; of occurrences with equally many windows the exact, then the most consistent one is told; empty
tables give no row; columns other than the ids (whole numbers) and text aren't read, and all are kept by `without_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import broadcast_if_small, ship, stored
from .groups import grouped, unused
from .memory import enter
from .words import Words, mix, slices, windows, words_of

N = 8
LEAST_LITERALS = 4
COVERAGE, LONG_MATCH = 0.4, 24
CONSISTENCY = 0.9
#: Steps between diagonals that still belong to one copy: none, some words more or less, a sentence.
SLACKS = (0, 4, 32)
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
BITS_PER_WINDOW, MOST_BITS = 1024, 1 << 27

# Number words and units of measure.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees mph kmh watt watts volt volts joule joules newton newtons meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters".split()


def _hashes_of(names: list[str]) -> np.ndarray:
    return np.sort(words_of(pa.array(names)).hashes)


_NUMBER_HASHES, _UNIT_HASHES = _hashes_of(NUMBER_WORDS), _hashes_of(UNITS)
_PLACEHOLDER = mix(np.array([0, 101, 202, 303], dtype=np.uint64))


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


@dataclass
class Templates:
    """Template tokens of texts: kinds, token hashes (placeholders for slots), slot value hashes (their two low bits are the kind), index of each text's first."""

    kinds: np.ndarray
    tokens: np.ndarray
    values: np.ndarray
    first: np.ndarray


def templates_of(w: Words) -> Templates:
    n = len(w.hashes)
    if not n:
        return Templates(np.zeros(0, dtype=np.uint8), w.hashes, w.hashes, np.zeros(len(w.first), dtype=np.int64))
    data, begin, end = w.data, w.begin, w.end
    digit = (data >= ord("0")) & (data <= ord("9"))
    digits = np.concatenate(([0], np.cumsum(digit)))
    number = digits[end] - digits[begin] == end - begin
    lead = data[begin]
    second = data[np.minimum(begin + 1, len(data) - 1)]
    capital = ((lead >= ord("A")) & (lead <= ord("Z"))) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    candidates = np.flatnonzero(capital)
    upper = (data >= ord("A")) & (data <= ord("Z"))
    uppers = np.concatenate(([0], np.cumsum(upper)))
    lower = np.concatenate(([0], np.cumsum((data >= ord("a")) & (data <= ord("z")))))
    mixed = (lower[end[candidates]] - lower[begin[candidates]] > 0) & (uppers[end[candidates]] - uppers[begin[candidates]] <= 2)
    at = begin[candidates]
    starts_text = np.isin(candidates, w.first)
    one, two = data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    ends = np.zeros(256, dtype=bool)
    ends[np.frombuffer(b".!?:\n\"", dtype=np.uint8)] = True
    starts = starts_text | ends[one] | ((one == ord(" ")) & ends[two])
    kinds = np.zeros(n, dtype=np.uint8)
    kinds[candidates[mixed & ~starts]] = NAME
    kinds[number | _among(w.hashes, _NUMBER_HASHES)] = NUMBER
    after = np.zeros(n, dtype=bool)
    after[1:] = kinds[:-1] == NUMBER
    after[w.first[:-1][w.first[:-1] < n]] = False
    kinds[after & (kinds == LITERAL) & _among(w.hashes, _UNIT_HASHES)] = UNIT
    opens = np.ones(n, dtype=bool)
    opens[1:] = (kinds[1:] == LITERAL) | (kinds[1:] != kinds[:-1])
    opens[w.first[:-1][w.first[:-1] < n]] = True
    heads = np.flatnonzero(opens)
    position = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
    values = np.add.reduceat(w.hashes * (np.uint64(2) * position.astype(np.uint64) + np.uint64(1)), heads)
    kinds = kinds[heads]
    tokens = np.where(kinds == LITERAL, w.hashes[heads], _PLACEHOLDER[kinds])
    return Templates(kinds, tokens, np.where(kinds == LITERAL, np.uint64(0), values & ~np.uint64(3) | kinds.astype(np.uint64)), np.searchsorted(heads, w.first))


def template_windows(t: Templates, n: int, least: int = LEAST_LITERALS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place) of windows that hold at least `least` literals; short texts as one window."""
    counts = np.diff(t.first)
    every = windows(t.tokens, n)
    owner = np.repeat(np.arange(len(counts)), counts)
    m = len(every)
    inside = owner[:m] == owner[n - 1 : n - 1 + m]
    literal = np.concatenate(([0], np.cumsum(t.kinds == LITERAL)))
    at = np.flatnonzero(inside & (literal[n : n + m] - literal[:m] >= least))
    hashes, owners, places = [every[at]], [owner[at]], [at - t.first[owner[at]]]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        own = slice(t.first[i], t.first[i + 1])
        if literal[own.stop] - literal[own.start] >= min(least, counts[i]):
            hashes.append(windows(t.tokens[own], counts[i]))
            owners.append(np.array([i]))
            places.append(np.array([0]))
    return np.concatenate(hashes), np.concatenate(owners), np.concatenate(places)


def _window_rows(df: DataFrame, id_name: str, n: int, table: np.ndarray | None = None) -> DataFrame:
    """(h, row, id, place, total, slots): windows with the values of their slots (0 for literals); total: windows of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("templates")
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in slices(batch, "text"):
                t = templates_of(words_of(piece.column("text")))
                h, owner, place = template_windows(t, n)
                total = np.bincount(owner, minlength=piece.num_rows)
                if table is not None:
                    bit = (h >> np.uint64(20)) & np.uint64(8 * len(table) - 1)
                    hit = np.flatnonzero(table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                    h, owner, place = h[hit], owner[hit], place[hit]
                if len(h):
                    at = np.minimum(t.first[owner][:, None] + place[:, None] + np.arange(n)[None, :], len(t.values) - 1)
                    slots = np.where(at < t.first[owner + 1][:, None], t.values[at], np.uint64(0)).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * n), pa.array(slots.reshape(-1)))
                    ids = piece.column("id").take(pa.array(owner))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(owner + row), ids, pa.array(place), pa.array(total[owner]), lists], ["h", "row", "id", "place", "total", "slots"])
                row += piece.num_rows

    return df.select(F.col(id_name).alias("id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "h long, row long, id long, place long, total long, slots array<long>")


def bit_table(hashes: DataFrame, size: int) -> np.ndarray:
    """A table of `size` bits with those of the column h set: one partial table per task of a few, joined here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("templates")
        table = np.zeros(size // 8, dtype=np.uint8)
        for batch in batches:
            bit = (batch.column("h").to_numpy().view(np.uint64) >> np.uint64(20)) & np.uint64(size - 1)
            np.bitwise_or.at(table, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": pa.array([table.tobytes()], type=pa.binary())})

    whole = np.zeros(size // 8, dtype=np.uint8)
    for x in hashes.select("h").coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        whole |= np.frombuffer(bytes(x["bits"]), dtype=np.uint8)
    return whole


def agreement(theirs: np.ndarray, ours: np.ndarray) -> tuple[int, float, bool]:
    """(different slot values, share that agree, whether all are the item's own) of slots laid side by side."""
    slot = theirs != 0
    pairs = np.unique(np.stack([theirs[slot], ours[slot]], axis=1), axis=0)
    if not len(pairs):
        return 0, 1.0, True
    one, two = (len(np.unique(pairs[:, i])) for i in (0, 1))
    number = (pairs[:, 0] & 3) == NUMBER
    back = int(number.sum()) + len(np.unique(pairs[~number, 1]))
    return max(one, two), min(one, back) / len(pairs), bool((pairs[:, 0] == pairs[:, 1]).all())


def occurrences(diagonal: np.ndarray, own: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Sets of at least `least` matched windows that may be one copy of the item: the item's own ones, and runs of diagonals."""
    at = np.flatnonzero(own)
    if len(at) >= least:
        yield at
    order = np.argsort(diagonal, kind="stable")
    steps = np.diff(diagonal[order])
    for slack in SLACKS:
        cuts = [0, *(np.flatnonzero(steps > slack) + 1).tolist(), len(order)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j - i >= least:
                yield order[i:j]


def leaks(docs: DataFrame, items: DataFrame, n: int = N, coverage: float = COVERAGE, long_match: int = LONG_MATCH, consistency: float = CONSISTENCY) -> DataFrame:
    """Contaminated (document, item) pairs of docs (doc_id, text) and items (item_id, text)."""
    ship(docs.sparkSession)
    known = stored(_window_rows(items, "item_id", n), "item-windows")
    size = 1 << 16
    wanted = known.count() * BITS_PER_WINDOW
    while size < min(wanted, MOST_BITS):
        size *= 2
    found = _window_rows(docs, "doc_id", n, bit_table(known, size))
    side = broadcast_if_small(known.select("h", F.col("row").alias("item_row"), F.col("id").alias("item_id"), F.col("place").alias("item_place"), F.col("total").alias("item_windows"), F.col("slots").alias("item_slots")), row_bytes=48 + 16 * n)
    met = found.join(side, "h").select("row", F.col("id").alias("doc_id"), F.col("place").alias("doc_place"), "item_row", "item_id", "item_place", "item_windows", "slots", "item_slots")
    met = met.repartition("row", "item_row").sortWithinPartitions("row", "item_row", "item_place")
    names = ["doc_id", "item_id", "n_windows", "item_windows", "coverage", "n_slots", "slot_consistency", "exact"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("templates")
        out: list[tuple] = []
        for group in grouped(batches, ["row", "item_row"]):
            places = group.column("item_place").to_numpy()
            total = group.column("item_windows")[0].as_py()

            def enough(count: int, total: int = total) -> bool:
                return count / max(total, 1) >= coverage or count + n - 1 >= long_match

            whole = len(np.unique(places))
            if not enough(whole):
                continue
            ours = np.asarray(group.column("slots").combine_chunks().flatten().to_numpy()).reshape(-1, n)
            theirs = np.asarray(group.column("item_slots").combine_chunks().flatten().to_numpy()).reshape(-1, n)
            held, agree, exact = agreement(theirs, ours)
            best = (whole, exact, agree, held) if agree >= consistency else None
            if best is None:
                least = next(x for x in range(1, whole + 1) if enough(x))
                for at in occurrences(group.column("doc_place").to_numpy() - places, (ours == theirs).all(axis=1), least):
                    count = len(np.unique(places[at]))
                    if not enough(count) or (best and count < best[0]):
                        continue
                    held, agree, exact = agreement(theirs[at], ours[at])
                    if agree >= consistency:
                        best = max(best or (0, False, 0.0, 0), (count, exact, agree, held))
            if best is None:
                continue
            count, exact, agree, held = best
            out.append((group.column("doc_id")[0].as_py(), group.column("item_id")[0].as_py(), count, total, count / max(total, 1), held, agree, exact))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return met.mapInArrow(judge, "doc_id long, item_id long, n_windows long, item_windows long, coverage double, n_slots long, slot_consistency double, exact boolean")


def without_leaks(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """The rows of docs whose text has no benchmark passage, with all their columns."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    mark, leak = unused(docs.columns, "mark", "leak")
    bad = stored(leaks(docs.select(key.alias("doc_id"), "text"), items, n).select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    return docs.withColumn(mark, key).join(broadcast_if_small(bad, row_bytes=32), F.col(mark) == F.col(leak), "left_anti").drop(mark)
