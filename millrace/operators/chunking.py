"""Chunkers: functions from passages (document_id, text) to chunks, by strategy name.

A strategy is a column function from a text to its parts, an array of PART structs; a chunker opens it
with one posexplode. So several strategies, and the adaptive choice between them, read their input once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..cluster import ship, stored
from ..functions.ids import chunk_id
from ..functions.text import is_blank, sentences, space_tokens, strip

COLUMNS = ["chunk_id", "document_id", "chunk_index", "strategy", "chunk_text", "character_count", "token_count", "start_offset", "end_offset", "overlap_before", "overlap_after"]
SENTENCES, SENTENCE_OVERLAP = 3, 1
TOKENS, TOKEN_OVERLAP = 256, 32
SHORT, MEDIUM, LONG_SENTENCE, LEAST_SENTENCES = 500, 2000, 500, 2
PART = "struct<text: string, tokens: int, start: int, end: int, before: int, after: int>"

Parts = Callable[[Column], Column]
TextChunker = Callable[[str], list[str]]
Chunker = Callable[[DataFrame], DataFrame]


class Tokenizer(Protocol):
    """What token chunks need; an object goes to the workers, so it should load what is large at first use."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class FileTokenizer:
    """A tokenizer file of the tokenizers library, loaded at first use in each worker."""

    _loaded: dict = {}

    def __init__(self, path: str):
        self.path = path

    def _tokenizer(self):
        if self.path not in self._loaded:
            from tokenizers import Tokenizer as Loaded

            self._loaded[self.path] = Loaded.from_file(self.path)
        return self._loaded[self.path]

    def encode(self, text: str) -> list[int]:
        return self._tokenizer().encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self._tokenizer().decode(ids, skip_special_tokens=True)


def default_tokenizer(path: str | None = None) -> Tokenizer | None:
    """The tokenizer of a file that is there; else none, which stands for white space."""
    import os

    return FileTokenizer(path) if path and os.path.exists(path) else None


def check_window(size: int, overlap: int) -> None:
    if isinstance(size, bool) or size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"a window needs size > overlap >= 0: {size}, {overlap}")


def windows(items: Column, size: int, overlap: int, to_end: bool) -> Column:
    """Slices of an array. to_end: windows stop once one reaches the end; else one begins at every stride."""
    n, stride = F.size(items), size - overlap
    last = F.ceil((n - size) / F.lit(float(stride))) if to_end else F.floor((n - 1) / F.lit(float(stride)))
    number = F.when(n <= size, 0).otherwise(last).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), number), lambda i: F.slice(items, i * stride + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def _part(text: Column, tokens: Column | None = None, whole: bool = False) -> Column:
    none, zero = F.lit(None).cast("int"), F.lit(0)
    sides = [zero, F.length(text), zero, zero] if whole else [none] * 4
    return F.struct(text, none if tokens is None else tokens, *sides).cast(PART)


def passage_parts(text: Column) -> Column:
    return F.array(_part(text, whole=True))


def sentence_parts(size: int = SENTENCES, overlap: int = SENTENCE_OVERLAP) -> Parts:
    """Windows of sentences joined by blanks; a text without a sentence is one part, stripped."""
    check_window(size, overlap)

    def parts(text: Column) -> Column:
        def of(s: Column) -> Column:
            joined = F.transform(windows(s, size, overlap, False), lambda w: _part(F.array_join(w, " ")))
            return F.when(F.size(s) == 0, F.array(_part(strip(text)))).otherwise(joined)

        return F.transform(F.array(sentences(text)), of)[0]  # sentences are split once

    return parts


def token_parts(size: int = TOKENS, overlap: int = TOKEN_OVERLAP, tokenizer: Tokenizer | None = None) -> Parts:
    """Windows of tokens: of white space words joined by blanks, or of a tokenizer's ids decoded, where a blank window is skipped and leaves a gap in the numbers."""
    check_window(size, overlap)

    def parts(text: Column) -> Column:
        if tokenizer is None:
            return F.transform(F.array(space_tokens(text)), lambda t: F.transform(windows(t, size, overlap, True), lambda w: _part(F.array_join(w, " "), F.size(w))))[0]
        ship()

        def cut(texts: pd.Series) -> pd.Series:
            out = []
            for x in texts:
                ids = tokenizer.encode(x) if x and x.strip() else []
                last = max(0, -(-(len(ids) - size) // (size - overlap)))
                held = [ids[i * (size - overlap) : i * (size - overlap) + size] for i in range(last + 1)] if ids else []
                out.append([{"text": tokenizer.decode(w), "tokens": len(w)} for w in held])
            return pd.Series(out)

        made = F.pandas_udf(cut, "array<struct<text: string, tokens: int>>")(text)
        return F.transform(made, lambda w: _part(w["text"], w["tokens"]))

    return parts


def check_lengths(short: int, medium: int) -> None:
    if not 0 < short < medium:
        raise ValueError("adaptive lengths need 0 < short < medium")


def adaptive_rule(text: Column, short: int = SHORT, medium: int = MEDIUM, tokens: bool = True) -> Column:
    """passage, sentence or token, by length and sentence marks; without tokens sentence stands in for token."""
    check_lengths(short, medium)
    marks = F.greatest(F.lit(1), F.length(text) - F.length(F.translate(text, ".?!।", "")))
    run = text.rlike(rf"(?:^|[.?!।])[^.?!।]{{{LONG_SENTENCE + 1}}}")  # a text without one, as most are, isn't split
    long_sentence = run & F.exists(F.split(text, "[.?!।]+"), lambda s: F.length(strip(s)) > LONG_SENTENCE)
    n, token = F.length(text), "token" if tokens else "sentence"
    return F.when(n <= short, "passage").when(long_sentence, token).when((n <= medium) & (marks >= LEAST_SENTENCES), "sentence").when(n <= medium, "passage").otherwise(token)


def adaptive_parts(short: int = SHORT, medium: int = MEDIUM, sentence: Parts | None = None, tokens: bool = True, tokenizer: Tokenizer | None = None) -> Parts:
    """Each text by the strategy its rule names; a blank one has no part. tokens=False: there is no tokenizer at all."""
    check_lengths(short, medium)
    sentence, token = sentence or sentence_parts(), token_parts(tokenizer=tokenizer)

    def parts(text: Column) -> Column:
        named = F.when(is_blank(text), "none").otherwise(adaptive_rule(text, short, medium, tokens))
        nothing = F.array().cast(f"array<{PART}>")
        if tokenizer is not None:  # runs in Python, for the texts that need it only
            cut = token(F.when(named == "token", text))
            return F.when(named == "passage", passage_parts(text)).when(named == "sentence", sentence(text)).when(named == "token", cut).otherwise(nothing)
        return F.transform(F.array(named), lambda r: F.when(r == "passage", passage_parts(text)).when(r == "sentence", sentence(text)).when(r == "token", token(text)).otherwise(nothing))[0]

    return parts


STRATEGIES: dict[str, Parts] = {"passage": passage_parts, "sentence": sentence_parts(), "token": token_parts(), "adaptive": adaptive_parts()}


def chunker(strategy: str, parts: Parts) -> Chunker:
    """Chunks of a strategy; blank parts are left out, but for a whole passage."""
    return lambda rows: _opened(rows.select("document_id", F.lit(strategy).alias("strategy"), F.posexplode(parts(F.col("text"))).alias("chunk_index", "p")))


def _opened(found: DataFrame) -> DataFrame:
    """Chunks of (document_id, strategy, chunk_index, p), p being a part."""
    p = F.col("p")
    kept = found.filter(p["start"].isNotNull() | ~is_blank(p["text"]))
    own = chunk_id(F.col("document_id"), F.col("strategy"), F.col("chunk_index"))
    shown = {"token_count": p["tokens"], "start_offset": p["start"], "end_offset": p["end"], "overlap_before": p["before"], "overlap_after": p["after"]}
    whole = kept.withColumn("chunk_id", own).withColumn("chunk_text", p["text"]).withColumn("character_count", F.length(p["text"]))
    return whole.withColumns(shown).select(*COLUMNS)


def passage_chunks(rows: DataFrame) -> DataFrame:
    return chunker("passage", passage_parts)(rows)


def sentence_chunks(rows: DataFrame, size: int = SENTENCES, overlap: int = SENTENCE_OVERLAP) -> DataFrame:
    return chunker("sentence", sentence_parts(size, overlap))(rows)


def token_chunks(rows: DataFrame, size: int = TOKENS, overlap: int = TOKEN_OVERLAP, tokenizer: Tokenizer | None = None) -> DataFrame:
    return chunker("token", token_parts(size, overlap, tokenizer))(rows)


def adaptive_chunks(rows: DataFrame, **settings) -> DataFrame:
    """Chunks by rule; they carry the strategy `adaptive` and ids of their own. settings: of adaptive_parts."""
    return chunker("adaptive", adaptive_parts(**settings))(rows)


def chunk_all(rows: DataFrame, strategies: dict[str, Parts] = STRATEGIES) -> DataFrame:
    """Chunks of every strategy from one pass over the rows. Where the adaptive strategy is that of the others, it takes their parts and makes none."""
    text, own = F.col("text"), dict(strategies)
    named = ("passage", "sentence", "token")
    shared = all(own.get(name) is STRATEGIES[name] for name in STRATEGIES)
    if shared:
        del own["adaptive"]
    held = rows.select("document_id", "text", *[parts(text).alias(f"parts_{name}") for name, parts in own.items()])
    column = {name: F.col(f"parts_{name}") for name in own}
    if shared:
        rule = F.transform(F.array(adaptive_rule(text)), lambda r: F.when(r == named[0], column[named[0]]).when(r == named[1], column[named[1]]).otherwise(column[named[2]]))[0]
        column["adaptive"] = F.when(is_blank(text), F.array().cast(f"array<{PART}>")).otherwise(rule)
    made = F.array(*[F.struct(F.lit(name).alias("strategy"), column[name].alias("parts")) for name in strategies])
    each = held.select("document_id", F.explode(made).alias("s"))
    return _opened(each.select("document_id", "s.strategy", F.posexplode("s.parts").alias("chunk_index", "p")))


class ChunkingEngine:
    """Strategies by name; further ones can be registered."""

    def __init__(self) -> None:
        self._made: dict[str, Chunker] = {"passage": passage_chunks, "sentence": sentence_chunks, "token": token_chunks, "adaptive": adaptive_chunks}

    def register(self, name: str, make: Chunker) -> None:
        if not name or not callable(make):
            raise ValueError("a strategy needs a name and a function")
        self._made[name] = make

    @property
    def strategies(self) -> list[str]:
        return sorted(self._made)

    def chunk(self, rows: DataFrame, strategy: str) -> DataFrame:
        if strategy not in self._made:
            raise ValueError(f"unknown strategy {strategy!r}; there are {self.strategies}")
        return rows.transform(self._made[strategy])


def text_chunker(name: str, make: TextChunker) -> Chunker:
    """A chunker of the engine from a function on texts; its chunks carry no tokens and offsets."""

    def chunk(rows: DataFrame) -> DataFrame:
        ship(rows.sparkSession)
        cut = F.pandas_udf(lambda texts: texts.map(lambda t: [p for p in make(t) if p.strip()], na_action="ignore"), "array<string>")
        parts = F.transform(cut(F.col("text")), lambda t: _part(t))
        return _opened(rows.select("document_id", F.lit(name).alias("strategy"), F.posexplode(parts).alias("chunk_index", "p")))

    return chunk


def chunk_function(name: str, make: TextChunker) -> type:
    """A polymorphic table function from texts to chunks with the columns of the engine.

    It takes (document_id, text) of a row, or a table that has these columns and may be partitioned:
    `FROM docs, LATERAL f(document_id, text)`, or `FROM f(TABLE(docs) PARTITION BY document_id)`.
    """

    class Chunks:
        @staticmethod
        def analyze(*given: AnalyzeArgument) -> AnalyzeResult:
            if len(given) == 1 and given[0].isTable:
                absent = {"document_id", "text"} - set(given[0].dataType.fieldNames())
                if absent:
                    raise ValueError(f"the table lacks {sorted(absent)}")
            elif len(given) != 2:
                raise ValueError("a chunker takes a table, or document_id and text")
            return AnalyzeResult(schema=T.StructType([T.StructField(c, t) for c, t in types.items()]))

        def eval(self, *given):
            key, text = (given[0]["document_id"], given[0]["text"]) if len(given) == 1 else given
            if text is None:
                return
            for i, part in enumerate(p for p in make(text) if p.strip()):
                mark = hashlib.sha256(f"document_id={key}:strategy={name}:chunk_index={i}".encode()).hexdigest()
                yield mark, str(key), i, name, part, len(part), None, None, None, None, None

    whole, text = T.IntegerType(), T.StringType()
    types = {c: text if c in ("chunk_id", "document_id", "strategy", "chunk_text") else whole for c in COLUMNS}
    return Chunks


def register_chunker(spark: SparkSession, engine: ChunkingEngine, name: str, make: TextChunker) -> None:
    """Make a function from a text to its parts a strategy of the engine, and a table function of SQL by the name `<name>_chunks`."""
    engine.register(name, text_chunker(name, make))
    spark.udtf.register(f"{name}_chunks", F.udtf(chunk_function(name, make)))


def quality(chunks: DataFrame, rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Metrics per strategy of chunks from rows (document_id, text); selected: document_id of relevant passages.

    Chunks are made once: what is measured of them is stored, without their texts. rows are read apart from that, so they should be cheap to read.
    """
    chunks = stored(chunks.select("strategy", "document_id", "chunk_id", "character_count", "token_count", (strip(F.col("chunk_text")) == "").alias("empty")), "measured")
    size = rows.agg(F.sum(F.length("text")).alias("input_chars"))
    hits = chunks.join(selected.select("document_id").distinct(), "document_id", "left_semi").groupBy("strategy").agg(F.count(F.lit(1)).alias("selected_chunks"))
    made = chunks.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum("character_count").alias("output_chars"),
        F.count_if("empty").alias("empty_chunks"),
        (F.count(F.lit(1)) - F.count_distinct("chunk_id")).alias("duplicate_ids"),
        F.round(F.avg("character_count"), 6).alias("avg_chars"),
        F.min("character_count").alias("min_chars"),
        F.max("character_count").alias("max_chars"),
        F.round(F.avg("token_count"), 6).alias("avg_tokens"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
    )
    whole = made.join(hits, "strategy", "left").join(F.broadcast(size))  # one row
    return whole.withColumn("coverage", F.round(F.col("output_chars") / F.col("input_chars"), 6)).withColumn("selected_chunks", F.coalesce("selected_chunks", F.lit(0)))


def compare(rows: DataFrame, selected: DataFrame, engine: ChunkingEngine | None = None, strategies: list[str] | None = None) -> DataFrame:
    """quality() of each strategy with its error (else null); one that fails gives a row of zeros, and the others go on."""
    engine, done = engine or ChunkingEngine(), None
    for name in strategies or ["passage", "sentence", "token", "adaptive"]:
        try:
            one = stored(quality(engine.chunk(rows, name).withColumn("strategy", F.lit(name)), rows, selected).withColumn("error", F.lit(None).cast("string")), "compared")
        except Exception as e:  # whatever a registered strategy raises, in the plan or in a task
            zeros = "chunks output_chars empty_chunks duplicate_ids avg_chars min_chars max_chars avg_tokens min_tokens max_tokens input_chars coverage selected_chunks".split()
            told = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            row = rows.sparkSession.range(1).select(F.lit(name).alias("strategy"), *[F.lit(0).alias(z) for z in zeros], F.lit(told).alias("error"))
            one = row
        done = one if done is None else done.unionByName(one)
    return done


def report(measured: DataFrame) -> str:
    """quality() or compare() as a table of fixed width; one row per strategy."""
    lines = [f"{'strategy':<12} {'chunks':>8} {'cover %':>8} {'chars':>9} {'empty':>6} {'doubles':>8} {'tokens':>8}"]
    for r in measured.orderBy("strategy").collect():
        tokens = "-" if r["avg_tokens"] is None else f"{r['avg_tokens']:.1f}"
        lines.append(f"{r['strategy']:<12} {r['chunks']:>8} {100 * (r['coverage'] or 0):>8.1f} {r['avg_chars'] or 0:>9.1f} {r['empty_chunks']:>6} {r['duplicate_ids']:>8} {tokens:>8}")
    return "\n".join(lines)
