"""Words of many texts at once, as numpy arrays over Arrow's own string buffers.

A word is a run of letters and digits: ASCII letters and digits, and every byte of a multi-byte
character other than no-break space and general punctuation (U+2000 to U+203F). A-Z and the
Latin-1 capitals are folded to lower case. Folding keeps byte lengths, so the byte offsets of a word
hold in the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[ord("0") : ord("9") + 1] = True
_IS_WORD[ord("A") : ord("Z") + 1] = True
_IS_WORD[ord("a") : ord("z") + 1] = True
_IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_ROOT = 0x9E3779B97F4A7C15
_POWERS = np.ones(4096, dtype=np.uint64)
for _i in range(1, len(_POWERS)):
    _POWERS[_i] = (int(_POWERS[_i - 1]) * _ROOT + 2) % (1 << 64) | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (two multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """hashes: of each word; begin, end: its bytes in `data` (`low`: folded); first: index of each text's first word, and their number at last."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text_at: np.ndarray
    data: np.ndarray
    low: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (length + 1, from 0) and bytes of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    at = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return at - at[0], data[at[0] : at[-1]]


def words_of(texts: pa.Array) -> Words:
    at, data = buffers(texts)
    n = len(data)
    low = _LOWER[data]
    is_word = _IS_WORD[data]
    if n > 1:
        after_c3 = np.flatnonzero(data[:-1] == 0xC3) + 1
        capital = after_c3[(data[after_c3] >= 0x80) & (data[after_c3] <= 0x9E) & (data[after_c3] != 0x97)]
        low[capital] += 32
        nbsp = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] == 0xA0))
        is_word[nbsp] = False
        is_word[nbsp + 1] = False
        general = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)) if n > 2 else nbsp[:0]
        for k in range(3):
            is_word[general + k] = False
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    lengths = ends - starts
    first = np.searchsorted(starts, at)
    if not len(starts):
        return Words(np.zeros(0, dtype=np.uint64), starts, ends, first, at, data, low)
    inside = low[is_word].astype(np.uint64)
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(inside)) - np.repeat(begin, lengths)
    if lengths.max() > len(_POWERS):
        place %= len(_POWERS)
    sums = np.add.reduceat((inside + np.uint64(1)) * _POWERS[place], begin)
    return Words(mix(sums + lengths.astype(np.uint64)), starts, ends, first, at, data, low)


def prefixes(w: Words, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size a hash of the first so many bytes of every word; 0 for words that aren't longer."""
    length, out = w.end - w.begin, []
    total = np.zeros(len(w.begin), dtype=np.uint64)
    for k in range(max(sizes)):
        total += (w.low[np.minimum(w.begin + k, len(w.low) - 1)].astype(np.uint64) + np.uint64(1)) * _POWERS[k] if len(w.low) else total
        if k + 1 in sizes:
            out.append(np.where(length > k + 1, mix(total ^ np.uint64(0x5851F42D4C957F2D + k)) | np.uint64(1), np.uint64(0)))
    return out


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n entries; shorter than n: none."""
    m = len(hashes) - n + 1
    if m <= 0:
        return hashes[:0]
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out += hashes[k : k + m] * _POWERS[k + 1]
    return mix(out)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each text, and where each text's begin; a text of 1 to n - 1 words has one window, of all its words."""
    counts = w.counts
    every = windows(w.hashes, n)
    number = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(number)))
    out = np.empty(bounds[-1], dtype=np.uint64)
    full = np.flatnonzero(counts >= n)
    if len(full):
        size = number[full]
        shift = np.repeat(bounds[full] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        run = np.arange(size.sum())
        out[run + shift] = every[run + np.repeat(w.first[full] - np.concatenate(([0], np.cumsum(size)[:-1])), size)]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        own = w.hashes[w.first[i] : w.first[i + 1]]
        out[bounds[i]] = windows(own, len(own))[0]
    return out, bounds


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `size` bytes of text; a longer text is a piece of its own."""
    if not batch.num_rows:
        return
    at, _ = buffers(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
