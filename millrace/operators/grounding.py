"""Grounding: claims of an answer against its evidence, as one ordered pass over answers and evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions.similarity import Evidence
from ..functions.text import claims, normalize, numbers, substantive_tokens

SUPPORT = 0.55
OVERLAP_WEIGHT = 0.7
#: Characters of evidence that an answer keeps until all its words are known, and claims of a batch that goes out.
HELD_CHARS, BATCH_CLAIMS = 16 << 20, 5000
#: What rounding may move a sum of two parts by, with room.
SLACK = 1e-12


class _Answer:
    """The claims of an answer, and what its evidence says of them, a piece at a time."""

    def __init__(self, key, sequence: bool):
        self.key, self.sequence = key, sequence
        self.numbered: list[tuple[int, str]] = []
        self.low: list[str] = []
        self.words: list[list[str]] = []
        self.lacking: list[set[str]] = []
        self.best: list[float] = []
        self.least: list[float] = []
        self.pieces: list[tuple[str, list[float]]] = []
        self.indexed: list[Evidence] = []
        self.chars = 0

    def ask(self, found: str, low: str, words: str, figures: str) -> None:
        """An answer's claims, a line each; they come before all evidence."""
        own = found.split("\n")
        self.numbered += enumerate(own)
        self.low += low.split("\n")
        self.words += [x.split() for x in words.split("\n")]
        self.lacking += [set(x.split()) for x in figures.split("\n")]
        self.best += [0.0] * len(own)
        self.least += [0.0] * len(own)

    def meet(self, text: str, words: str, figures: str) -> None:
        """A piece of evidence: a claim costs its own words, however long the piece is."""
        own, there, overlaps = set(words.split()), set(figures.split()), []
        for i, mine in enumerate(self.words):
            if self.lacking[i]:
                self.lacking[i] -= there
            overlap = 0.0
            if mine:
                overlap = len(own.intersection(mine)) / len(mine)
                if not self.sequence:
                    self.best[i] = max(self.best[i], overlap)
            elif self.low[i] in text:
                self.best[i] = 1.0
            overlaps.append(overlap)
        if self.sequence and own:
            if self.pieces and self.chars + len(text) > HELD_CHARS:
                self.compare()
            self.least = [max(a, OVERLAP_WEIGHT * b) for a, b in zip(self.least, overlaps, strict=True)]
            self.pieces.append((text, overlaps))
            self.chars += len(text)

    def index(self) -> list[tuple[Evidence, list[float]]]:
        """The pieces held, each indexed once."""
        self.indexed += [Evidence(text) for text, _ in self.pieces[len(self.indexed) :]]
        return [(e, overlaps) for e, (_, overlaps) in zip(self.indexed, self.pieces, strict=True)]

    def exact(self, i: int) -> float:
        """The best of a claim with words; a piece that can't reach its least known best keeps the part its words give."""
        best = self.best[i]
        for index, overlaps in self.index():
            score = OVERLAP_WEIGHT * overlaps[i]
            if score + (1 - OVERLAP_WEIGHT) * index.bound(self.low[i]) >= max(self.least[i], best) - SLACK:
                score += (1 - OVERLAP_WEIGHT) * index.ratio(self.low[i])
            best = max(best, score)
        return best

    def below(self, i: int, threshold: float) -> bool:
        """That a claim surely stays below the threshold: by lengths, or else by counts of characters."""
        low, room = self.low[i], threshold - SLACK
        if self.best[i] >= room:
            return False
        short = lambda text: 2.0 * min(len(low), len(text)) / (len(low) + len(text))
        if all(OVERLAP_WEIGHT * overlaps[i] + (1 - OVERLAP_WEIGHT) * short(text) < room for text, overlaps in self.pieces):
            return True
        return all(OVERLAP_WEIGHT * overlaps[i] + (1 - OVERLAP_WEIGHT) * index.bound(low) < room for index, overlaps in self.index())

    def compare(self) -> None:
        """Scores of all claims by the pieces held, which go."""
        self.best = [self.exact(i) if words else self.best[i] for i, words in enumerate(self.words)]
        self.pieces, self.indexed, self.chars = [], [], 0

    def rows(self) -> list[tuple]:
        """Score of each claim; one with a number that no evidence has isn't compared."""
        scores = [0.0 if self.lacking[i] else self.exact(i) if words else self.best[i] for i, words in enumerate(self.words)]
        return [(self.key, no, claim, score) for (no, claim), score in zip(self.numbered, scores, strict=True)]

    def verdict(self, threshold: float) -> list[tuple]:
        """What roll_up makes of rows(). Texts are compared for claims whose support or part in the score their words leave open only."""
        n = len(self.numbered)
        if not n:
            return []
        scores: list[float | None] = [0.0 if self.lacking[i] else None if words and self.pieces else self.best[i] for i, words in enumerate(self.words)]
        least = [max(a, b) for a, b in zip(self.best, self.least, strict=True)]
        flagged = []
        for i, score in enumerate(scores):
            if score is None and least[i] < threshold:
                if self.below(i, threshold):
                    flagged.append(self.numbered[i])
                    continue
                score = scores[i] = self.exact(i)
            if score is not None and score < threshold:
                flagged.append(self.numbered[i])
        if not flagged:
            total = 0.0
            for i, x in enumerate(scores):
                total += self.exact(i) if x is None else x  # in order, as roll_up adds; sum() would round otherwise
            return [(self.key, n, "grounded", total / n, [])]
        lowest = min((x for x in scores if x is not None), default=1.0)
        for i in sorted((i for i, x in enumerate(scores) if x is None), key=least.__getitem__):
            if least[i] >= lowest:
                break
            lowest = min(lowest, self.exact(i))
        return [(self.key, n, "flagged", lowest, [claim for _, claim in sorted(flagged)])]


def _judged(answers: DataFrame, evidence: DataFrame, sequence: bool, rows_of: Callable[[_Answer], list[tuple]], columns: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """What rows_of makes of each answer and its evidence, as (answer_id, columns).

    Texts are shuffled once, raw, and come to a task by answer, its claims first; a task holds one answer's claims and a
    bounded part of its evidence.
    """
    ship(answers.sparkSession)
    asked = answers.select("answer_id", F.lit(False).alias("held"), F.col("answer").alias("text"))
    held = evidence.filter("answer_id IS NOT NULL").select("answer_id", F.lit(True).alias("held"), "text")
    rows = asked.unionAll(held).repartition("answer_id").sortWithinPartitions("answer_id", "held")
    # Claims and pieces have no line feed, so a text has a line for each claim, and one string goes to Python faster than many.
    lines = lambda f: F.array_join(F.transform("parts", f), "\n")
    rows = rows.select("answer_id", "held", F.when(F.col("held"), F.array(normalize(F.col("text"), False))).otherwise(claims(F.when(~F.col("held"), F.col("text")))).alias("parts"))
    rows = rows.select("answer_id", "held", F.when(~F.col("held"), F.array_join("parts", "\n")).alias("claims"), lines(F.lower).alias("low"), lines(lambda c: F.array_join(substantive_tokens(c), " ")).alias("words"), lines(lambda c: F.array_join(numbers(c), " ")).alias("numbers"))
    names = ["answer_id", *(name for name, _, _ in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, kind, size = None, [], None, 0

        def shown() -> pa.RecordBatch:
            kinds = (kind, *(t for _, _, t in columns))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            kind = batch.schema.field("answer_id").type
            for key, is_held, found, text, words, figures in zip(*(batch.column(c).to_pylist() for c in ("answer_id", "held", "claims", "low", "words", "numbers")), strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        out += rows_of(now)
                        size += len(now.numbered)
                    now = _Answer(key, sequence)
                if not is_held:
                    if found:
                        now.ask(found, text, words, figures)
                elif text and now.numbered:
                    now.meet(text, words, figures)
                if size >= BATCH_CLAIMS:
                    if out:
                        yield shown()
                    out, size = [], 0
        out += rows_of(now) if now is not None else []
        if out:
            yield shown()

    return rows.mapInArrow(run, ", ".join([f"answer_id {dict(answers.dtypes)['answer_id']}", *(f"{name} {kind}" for name, kind, _ in columns)]))


def claim_scores(answers: DataFrame, evidence: DataFrame, sequence: bool = True) -> DataFrame:
    """(answer_id, claim_no, claim, score) for answers (answer_id, answer) and evidence (answer_id, text).

    Words are compared with each piece of evidence, numbers with all of it. sequence=False leaves out
    the character similarity, and the word overlap alone is the score.
    """
    return _judged(answers, evidence, sequence, _Answer.rows, [("claim_no", "int", pa.int32()), ("claim", "string", pa.string()), ("score", "double", pa.float64())])


def verify(answers: DataFrame, evidence: DataFrame, sequence: bool = True, threshold: float = SUPPORT) -> DataFrame:
    """roll_up(claim_scores(answers, evidence, sequence), threshold) in the same pass, so no score is shuffled, and characters are compared only where that can change the row."""
    columns = [("claims", "long", pa.int64()), ("verdict", "string", pa.string()), ("score", "double", pa.float64()), ("flagged", "array<string>", pa.list_(pa.string()))]
    return _judged(answers, evidence, sequence, lambda x: x.verdict(threshold), columns)


def roll_up(scores: DataFrame, threshold: float = SUPPORT) -> DataFrame:
    """Per answer: the mean score if all claims are supported, else the least; verdict; flagged claims in order."""
    flagged = F.transform(F.sort_array(F.collect_list(F.when(F.col("score") < threshold, F.struct("claim_no", "claim")))), lambda x: x["claim"])
    whole = scores.groupBy("answer_id").agg(F.avg("score").alias("mean"), F.min("score").alias("least"), F.count(F.lit(1)).alias("claims"), flagged.alias("flagged"))
    grounded = F.size("flagged") == 0
    return whole.select("answer_id", "claims", F.when(grounded, "grounded").otherwise("flagged").alias("verdict"), F.when(grounded, F.col("mean")).otherwise(F.col("least")).alias("score"), "flagged")
