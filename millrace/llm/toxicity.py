"""Operator 1, toxicity by noisy-channel deobfuscation.

1. A character trigram model with word boundaries is counted over all documents.
2. Chunks that look disguised (digits or signs among letters, letters in runs, letters set apart one by
   one) become lattices: each unit may be the letters it stands for, a separator may vanish or end a
   word, a run may be one letter or two. Viterbi decoding under the model picks the cheapest reading.
   What stands between signs is also read by itself. Letters set apart one by one are read both as one word and with their gaps as possible ends of words.
3. Words of the text and of its readings, and their first letters, are looked up in a table of those that
   mark toxic rows. A logistic regression on the marks met and on their share of the words gives the score; a mark
   that is almost never met in other rows gives its share of toxic rows at least.

Table and regression are learnt from labelled rows that aren't held out, at most about `most_labelled`
of them, chosen by a hash of doc_id; labels, lang, source and doc_id aren't inputs of a score.

Per row: doc_id, held_out, score, predicted (1 from 0.7 on), n_restored (disguised words read as marked ones).

Defined cases: null and empty texts get the base score; null ids count as held out (their remainder is
unknown) and are scored; repeated rows each keep their row; an id with several labels is toxic if one of
them says so; without labels of both kinds every score is the share of toxic rows, 0.5 added to both
kinds; an empty table of documents gives no row; very long texts are read in whole, disguised chunks of any
length in pieces of MOST_UNITS units that overlap by half, begun after a sign where there is one; readings
of equal cost go to the first in order; columns other than doc_id (a whole number) and text aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship, stored
from .memory import enter, held
from .words import Words, prefixes, slices, words_of

MOST_LABELLED = 20_000
CUT = 0.7
MOST_UNITS = 48
GAP = "\x1f"  # between letters set apart
MOST_KNOWN = 100_000
LEAST_ROWS, LEAST_ROOT_G, LEAST_SHARE = 4, 4.5, 0.5
PREFIXES = (4, 5, 6, 7)
STEPS, RATE, PENALTY = 400, 0.1, 1e-4
SURE = 0.85
ALPHABET = 28  # boundary, a to z, any other

# The letters that a sign may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "µ": "u", "ø": "o", "а": "a", "е": "e", "і": "i", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "*": "aeiou", "#": "h", "%": "x", "&": "a"}
REPLACED, DROPPED, PARTED, KEPT = 0.7, 0.6, 2.0, 4.0
GAP_ENDS = 0.0
#: Signs that stand for no letter; what lies between two of them is also read by itself.
SIGNS = re.compile(r"[-_.~^=:;,/\\'\"]+")
THRICE = re.compile(r"(.)\1\1", re.I)
RUNS = {1: ((1, 0.0),), 2: ((2, 0.0), (1, 6.0)), 3: ((1, 0.4), (2, 0.8), (3, 3.0))}


def _codes(data: np.ndarray) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord("A") : ord("Z") + 1] = np.arange(1, 27)
    table[ord("0") : ord("9") + 1] = 27
    table[0x80:] = 27
    return table[data]


def trigram_counts(text_at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Counts of (before last, last, next) codes, flat; text before a boundary doesn't reach beyond it."""
    if not len(data):
        return np.zeros(ALPHABET**3, dtype=np.int64)
    c = np.zeros(len(data) + len(text_at) + 1, dtype=np.int64)
    shift = np.repeat(np.arange(len(text_at) - 1), np.diff(text_at))
    c[np.arange(len(data)) + shift + 2] = _codes(data)
    one, two = c[1:-1], np.where(c[1:-1] == 0, 0, c[:-2])
    index = (two * ALPHABET + one) * ALPHABET + c[2:]
    return np.bincount(index[(one > 0) | (c[2:] > 0)], minlength=ALPHABET**3)


def character_model(docs: DataFrame) -> np.ndarray:
    """Costs (negative log probabilities) of a next code after two, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        total = np.zeros(ALPHABET**3, dtype=np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                w = words_of(piece.column("text"))
                total += trigram_counts(w.text_at, w.data)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    counts = np.zeros(ALPHABET**3)
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    for x in rows.collect():  # at most ALPHABET^3 rows
        counts[x["code"]] = x["n"]
    counts = counts.reshape(ALPHABET, ALPHABET, ALPHABET)
    single = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + ALPHABET)
    double = counts.sum(axis=0)
    double = (double + 20 * single) / (double.sum(axis=1, keepdims=True) + 20)
    triple = (counts + 5 * double[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    return -np.log(triple)


class Decoder:
    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.known: dict[str, list[str]] = {}

    def words(self, chunk: str) -> list[str]:
        if chunk not in self.known:
            if len(self.known) > MOST_KNOWN:
                self.known.clear()
            found = self.parts(chunk.replace(GAP, ""))
            if GAP in chunk:
                found += [x for x in self.parts(chunk) if x not in found]
            between = SIGNS.split(chunk)
            if len(between) > 1:
                own = {w for x in set(between) if len(x) > 2 and (not x.isalpha() or THRICE.search(x)) for w in self.parts(x)}
                found += sorted(own.difference(found))
            if len(chunk) > MOST_UNITS:  # seldom met again
                return found
            self.known[chunk] = found
        return self.known[chunk]

    def parts(self, chunk: str) -> list[str]:
        units = lattice(chunk.lower())
        return [w for i, j in pieces(units) for w in self.cheapest(units[i:j]).split()]

    def read(self, chunk: str) -> str:
        """The cheapest reading of a chunk."""
        return self.cheapest(lattice(chunk.lower()))

    def cheapest(self, units: list[list[tuple[str, float]]]) -> str:
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in units:
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (two, one), (cost, text) in states.items():
                for letters, price in options:
                    a, b, total = two, one, cost + price
                    for x in letters:
                        c = ord(x) - 96 if "a" <= x <= "z" else 0 if x == " " else 27
                        if c == 0 and b == 0:
                            continue
                        total += self.costs[a][b][c]
                        a, b = (0, 0) if c == 0 else (b, c)
                    if (a, b) not in after or after[a, b][0] > total:
                        after[a, b] = (total, text + letters)
            states = after
        ends = [(cost + (self.costs[two][one][0] if one else 0.0), text) for (two, one), (cost, text) in states.items()]
        return min(ends)[1]


def pieces(units: list[list[tuple[str, float]]]) -> Iterator[tuple[int, int]]:
    """Cuts of units, each MOST_UNITS long at most; a word of up to a quarter of that stands whole in one of them."""
    at = 0
    while at + MOST_UNITS < len(units):
        yield at, at + MOST_UNITS
        half, quarter = at + MOST_UNITS // 2, at + MOST_UNITS // 4
        at = next((i + 1 for i in range(half, quarter, -1) if units[i][-1][0] == " "), half)
    yield at, len(units)


def lattice(chunk: str) -> list[list[tuple[str, float]]]:
    """Readings with prices of each unit: a run of one character."""
    units, i = [], 0
    while i < len(chunk):
        x, n = chunk[i], 1
        while i + n < len(chunk) and chunk[i + n] == x:
            n += 1
        i += n
        if x == GAP:
            units.append([("", 0.0), (" ", GAP_ENDS)])
            continue
        looks = LOOKS_LIKE.get(x, "")
        if x.isalpha() and not looks:
            units.append([(x * k, price) for k, price in RUNS[min(n, 3)]] + ([(x * n, 3.0)] if n > 3 else []))
            continue
        options = [(y * min(n, k), price + REPLACED) for y in looks for k, price in RUNS[min(n, 3)]]
        if x.isdigit():
            options.append((x * n, KEPT))
        elif not x.isalpha():
            options += [("", DROPPED), (" ", PARTED)]
        units.append(options)
    return units


def disguised(w: Words) -> tuple[list[str], np.ndarray]:
    """Chunks that look disguised and the numbers of their texts. Letters set apart are returned as one chunk, with GAP between them."""
    data = w.data
    n = len(data)
    if not n or not len(w.hashes):
        return [], np.zeros(0, dtype=np.int64)
    letter = ((data | 32) >= ord("a")) & ((data | 32) <= ord("z"))
    digit = (data >= ord("0")) & (data <= ord("9"))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.zeros(n + 1, dtype=bool)
    edges[w.text_at] = True
    begins = np.flatnonzero(~blank & (np.concatenate(([True], blank[:-1])) | edges[:-1]))
    ends = np.flatnonzero(~blank & (np.concatenate((blank[1:], [True])) | edges[1:])) + 1

    def mark(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(begins, at, side="right") - 1

    sign = np.zeros(256, dtype=bool)
    sign[np.frombuffer(b"@$!|+(<{*#%&.-_'~^=:;,/\\", dtype=np.uint8)] = True
    flagged = [np.zeros(0, dtype=np.int64)]
    next_letter = np.concatenate((letter[1:], [False]))
    flagged.append(mark(np.flatnonzero(digit[:-1] & letter[1:] | letter[:-1] & digit[1:])))
    inner = np.flatnonzero((sign[data] | (data >= 0x80)) & next_letter)  # signs before a letter, with a letter before them
    inner = inner[inner > 0]
    back = inner - 1
    for _ in range(3):
        loose = (sign[data[back]] | (data[back] >= 0x80)) & (back > 0)
        back = np.where(loose, back - 1, back)
    held = letter[back] & ((data[inner] < 0x80) | np.isin(data[inner], np.frombuffer("іе".encode()[1::2] + "аоресхуñ".encode()[1::2] + b"\x8b\x8c\x8d", dtype=np.uint8)))
    lead = data[np.maximum(inner - 1, 0)]
    held &= (data[inner] < 0x80) | np.isin(lead, np.array([0xD0, 0xD1, 0x80], dtype=np.uint8))
    flagged.append(mark(inner[held]))
    low = data | 32
    if n > 2:
        flagged.append(mark(np.flatnonzero(letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]))))
    dollar = np.flatnonzero(((data == ord("$")) | (data == ord("@"))) & np.concatenate(([False], letter[:-1])))
    if len(dollar):
        own = mark(dollar)
        flagged.append(own[ends[own] - dollar <= 2])
    leading = np.flatnonzero(((data == ord("$")) | (data == ord("@"))) & next_letter)
    flagged.append(mark(leading))
    chunks = np.unique(np.concatenate(flagged))
    raw = data.tobytes()
    texts = [raw[begins[c] : ends[c]].decode("utf-8", "replace") for c in chunks.tolist()]
    owners = np.searchsorted(w.text_at, begins[chunks], side="right") - 1
    # Words of one letter in a row, each at most two bytes from the next.
    single = np.flatnonzero((w.end - w.begin == 1) & (letter[w.begin] | digit[w.begin]))
    if len(single) >= 3:
        owner = np.searchsorted(w.text_at, w.begin[single], side="right") - 1
        linked = (np.diff(single) == 1) & (np.diff(w.begin[single]) <= 3) & (np.diff(owner) == 0)
        cuts = np.flatnonzero(np.concatenate(([True], ~linked, [True])))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if j - i >= 3:
                texts.append(GAP.join(bytes(data[w.begin[single[i:j]]]).decode()))
                owners = np.append(owners, owner[i])
    return texts, owners


def _decoder(costs: np.ndarray) -> Decoder:
    """The worker's decoder of a character model, with what it has read so far."""
    return held(f"decoder-{hash(costs.tobytes())}", lambda: Decoder(costs))


def restored(w: Words, decoder: Decoder) -> tuple[Words, np.ndarray]:
    """The words that disguised chunks read as, and their texts' numbers."""
    chunks, owners = disguised(w)
    words, at = [], []
    for chunk, owner in zip(chunks, owners.tolist(), strict=True):
        for x in decoder.words(chunk):
            words.append(x)
            at.append(owner)
    found = words_of(pa.array(words, type=pa.string()))
    return found, np.repeat(np.array(at, dtype=np.int64), found.counts)


@dataclass
class Model:
    """costs: of the character model; marks: sorted hashes of marking words and beginnings; weights: theirs, then of their share of the words; base: log odds without any; sure: the least share of toxic rows of marks that decide alone, else 0."""

    costs: np.ndarray
    marks: np.ndarray
    weights: np.ndarray
    base: float
    sure: np.ndarray


def _features(w: Words, decoder: Decoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, read from a disguise) of every word and beginning."""
    more, at = restored(w, decoder)
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    hashes, owners = [w.hashes, more.hashes], [owner, at]
    disguise = [np.zeros(len(w.hashes), dtype=bool), np.ones(len(at), dtype=bool)]
    for words, own, read in ((w, owner, False), (more, at, True)):
        for h in prefixes(words, PREFIXES):
            held = np.flatnonzero(h)
            hashes.append(h[held])
            owners.append(own[held])
            disguise.append(np.full(len(held), read))
    return np.concatenate(hashes), np.concatenate(owners), np.concatenate(disguise)


def _distinct_words(docs: DataFrame, costs: np.ndarray, *names: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for batch in batches:
            for piece in slices(batch, "text"):
                w = words_of(piece.column("text"))
                hashes, owner, _ = _features(w, _decoder(costs))
                order = np.lexsort((hashes, owner))
                owner, hashes = owner[order], hashes[order]
                keep = np.ones(len(owner), dtype=bool)
                keep[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
                columns = [piece.column(n).take(pa.array(owner[keep])) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), *columns], ["word", *names])

    return docs.mapInArrow(run, "word long, " + ", ".join(f"{n} {kinds[n]}" for n in names))


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's text leaves 1 modulo 3, and for rows without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """The character model over all docs and the word table from at most about most_labelled rows that aren't held out."""
    ship(docs.sparkSession)
    costs = character_model(docs)
    marks = labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = stored(marks, "labels")
    share = min(1.0, most_labelled / max(1, marks.count()))
    chosen = marks.filter(F.pmod(F.xxhash64(F.lit(3), "label_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    if most_labelled * 24 < 24 << 20:
        chosen = F.broadcast(chosen)  # about most_labelled rows of two numbers
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("label_id")).select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    rows = stored(rows, "labelled")
    totals = rows.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).first()
    a_all, b_all = totals["a"] or 0, totals["b"] or 0
    counted = _distinct_words(rows, costs, "toxic").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    n = max(a_all + b_all, 1)
    expect = (F.col("a") + F.col("b")) * (a_all / n)
    rest = (F.col("a") + F.col("b")) * (b_all / n)
    g = 2 * (F.col("a") * F.log(F.col("a") / expect) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / rest)).otherwise(0.0))
    strong = counted.filter((F.col("a") >= LEAST_ROWS) & (F.col("a") >= LEAST_SHARE * (F.col("a") + F.col("b"))) & (F.col("a") > expect)).withColumn("g", g)
    found = strong.filter(F.col("g") >= LEAST_ROOT_G**2).select("word", "a", "b").collect()  # words of at least LEAST_ROWS of at most about most_labelled rows
    known = sorted((x["word"] % (1 << 64), _least_share(x["a"], x["a"] + x["b"])) for x in found)
    marks = np.array([w for w, _ in known], dtype=np.uint64)
    sure = np.array([p if p >= SURE else 0.0 for _, p in known])
    start = math.log((a_all + 0.5) / (b_all + 0.5))
    if not len(marks):
        return Model(costs, marks, np.zeros(1), start, sure)
    given = rows.mapInArrow(_counts(costs, marks), "toxic int, words long, places array<long>, counts array<long>").toPandas()  # about most_labelled rows
    weights, base = _regression(given, len(marks), start)
    return Model(costs, marks, weights, base, sure)


def _least_share(hits: int, n: int, z: float = 1.96) -> float:
    """Lower bound of a share by Wilson's interval."""
    p = hits / n
    return max(0.0, (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def _counts(costs: np.ndarray, marks: np.ndarray):
    """Per labelled row the marks it has and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for batch in batches:
            for piece in slices(batch, "text"):
                w = words_of(piece.column("text"))
                owner, place, count, _ = _found(w, _decoder(costs), marks)
                at = np.searchsorted(owner, np.arange(piece.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (place, count)]
                yield pa.RecordBatch.from_arrays([piece.column("toxic"), pa.array(w.counts.astype(np.int64)), *lists], ["toxic", "words", "places", "counts"])

    return run


def _regression(given, marks: int, start: float) -> tuple[np.ndarray, float]:
    """Weights and base of the least mean log loss with a small penalty, by gradient steps of adapted size."""
    sizes = given["places"].map(len).to_numpy()
    row = np.repeat(np.arange(len(given)), sizes)
    column = np.concatenate(given["places"].tolist()).astype(np.int64) if sizes.sum() else np.zeros(0, dtype=np.int64)
    counts = np.concatenate(given["counts"].tolist()).astype(np.float64) if sizes.sum() else np.zeros(0)
    share = _share(np.bincount(row, weights=counts, minlength=len(given)), given["words"].to_numpy())
    y = given["toxic"].to_numpy()
    theta = np.zeros(marks + 2)
    theta[-1] = start
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        odds = theta[-1] + theta[-2] * share + np.bincount(row, weights=theta[column], minlength=len(given))
        miss = (1 / (1 + np.exp(-odds)) - y) / len(given)
        slope = np.append(np.bincount(column, weights=miss[row], minlength=marks), [share @ miss, miss.sum()])
        slope[:-1] += PENALTY * theta[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def _share(hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Marks per thousand words, on a log scale; short texts count as a hundred words."""
    return np.log1p(1000 * hits / np.maximum(words, 100))


def _found(w: Words, decoder: Decoder, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place in marks, count, read from a disguise) of each text's marks, in order."""
    none = np.zeros(0, dtype=np.int64)
    if not len(marks):
        return none, none, none, none.astype(bool)
    hashes, owner, disguise = _features(w, decoder)
    place = np.minimum(np.searchsorted(marks, hashes), len(marks) - 1)
    hit = np.flatnonzero(marks[place] == hashes)
    if not len(hit):
        return none, none, none, none.astype(bool)
    keys, first, count = np.unique(owner[hit] * len(marks) + place[hit], return_index=True, return_counts=True)
    return keys // len(marks), keys % len(marks), count, disguise[hit[first]]


def _scores(w: Words, owner: np.ndarray, place: np.ndarray, count: np.ndarray, model: Model) -> np.ndarray:
    """Score of each text from its marks."""
    rows = len(w.counts)
    own = np.bincount(owner, weights=model.weights[place], minlength=rows)
    share = _share(np.bincount(owner, weights=count, minlength=rows), w.counts)
    score = 1 / (1 + np.exp(-(model.base + own + model.weights[-1] * share)))
    np.maximum.at(score, owner, model.sure[place])
    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_restored of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for batch in batches:
            for piece in slices(batch, "text"):
                w = words_of(piece.column("text"))
                owner, place, count, read = _found(w, _decoder(model.costs), model.marks)
                value = _scores(w, owner, place, count, model)
                number = np.bincount(owner[read], minlength=piece.num_rows)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(value), pa.array((value >= CUT).astype(np.int32)), pa.array(number)], ["doc_id", "held_out", "score", "predicted", "n_restored"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_restored long")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for batch in batches:
            for piece in slices(batch, "text"):
                w = words_of(piece.column("text"))
                owner, place, count, _ = _found(w, _decoder(model.costs), model.marks)
                yield piece.filter(pa.array(_scores(w, owner, place, count, model) < CUT))

    return docs.mapInArrow(run, docs.schema)
