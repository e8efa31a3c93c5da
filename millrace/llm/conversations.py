"""Operator 13, conversation structure repair: the cheapest edits per signature, by dynamic programming shared along a trie.

Each turn of a conversation becomes one symbol, its role's initial and its first fault; a conversation becomes
the string of them, its signature. The distinct signatures are sorted by range. A task that goes through sorted
signatures walks their prefix trie depth first: the path to the signature before is a stack of layers, of
which those of the common prefix stay and only the rest is computed. A terminal node, the end of a signature, reads
its edits off the stack. So however many conversations share a signature or its beginning, its layers are made once a task.

A layer has a cost for each state of the grammar `(s?(ua)+)?` (nothing yet, s, u, a) and the rank of its edits among
those of the other states. Edits of a layer end with the edit of a turn, so none of them begins another, and ranks decide ties
without comparing strings. As only differences of costs matter, layers repeat, and the step from one is looked up after its first use.

Turns are sorted by turn (nulls first), of equal ones by role, then by the digest of the text; role and text count with
nulls as one space. Sorting, faults and signatures go without texts; a second pass carries the texts in order through the edits. Both
passes stream a conversation through one task (its hash needs the order), which holds one byte a turn and no text but the present batch.

Defined cases: turns whose conv_id is null are one conversation of that id; turns without a turn number come first and count in no gap; a role
with another initial than s, u or a, the empty one included, can't be kept; repeated rows are duplicates; texts of any length are read whole; a conversation
left without turns has the empty repair; an empty table gives no row; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..cluster import ship, stored

BLANKS = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a. A new user turn or assistant turn leads from each to:
START, S, U, A = range(4)
NEXT_TURN = {START: U, S: U, U: A, A: U}
#: A kept initial leads from a state to the next.
KEPT = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}, "o": {}}
#: Two added turns reach every state that more would reach.
MOST_INSERTS = 2
#: A state that costs so much more than the best can't be part of a cheapest repair: A is at most two insertions away, and does what any state does at the price of one deletion.
PRUNE = 2 * INSERT + DELETE
BATCH_ROWS, BATCH_CHARS = 4096, 4 << 20


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, dropped of every row after the damage that crc32 of `conv_id:turn` deals it."""
    kind = F.pmod(F.crc32(F.concat_ws(":", _filled("conv_id"), _filled("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_filled("text"), "[.!?]", "")).otherwise(_filled("text"))
    hurt = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(_filled("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return hurt.select("conv_id", "turn", "role", "text", "dropped", F.explode("copies").alias("copy"))


def whole(rows: DataFrame) -> DataFrame:
    """Rows without damage in the form damage() gives."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _filled("role").alias("role"), _filled("text").alias("text"), F.lit(False).alias("dropped"), F.lit(0).alias("copy"))


_ORDER = ["turn", "role", "digest", "copy"]


def _keyed(turns: DataFrame) -> DataFrame:
    return turns.withColumn("digest", F.unhex(F.sha2("text", 256)))


def marked(turns: DataFrame) -> DataFrame:
    """conv_id, the order of turns, initial, fault (blank, duplicate, truncated or null) and symbol of each; symbols of dropped ones are null."""
    bare = F.rtrim("text", F.lit(BLANKS))
    plain = _keyed(turns).select("conv_id", *_ORDER, "dropped", (F.length(bare) == 0).alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy("turn", "copy"))
    fault = F.when(F.col("blank"), "blank").when(F.col("again") > 1, "duplicate").when(~F.col("ended"), "truncated")
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    rows = plain.repartition("conv_id").withColumn("again", earlier).withColumn("initial", F.left("role", F.lit(1))).withColumn("fault", fault)
    return rows.select("conv_id", *_ORDER, "initial", "fault", F.when(~F.col("dropped"), symbol).alias("symbol"))


_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_SIGNED = "gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


class _Signed:
    """What is counted of one conversation while its turns go by."""

    def __init__(self, key):
        self.key, self.first, self.last, self.turns, self.illegal, self.before, self.symbols = key, None, None, 0, 0, None, []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn, initial, fault, symbol):
        if symbol is None:
            return
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if fault:
            self.faults[fault] += 1
        self.illegal += self.before is not None and (self.before, initial) not in _LEGAL
        self.before = initial
        self.symbols.append(symbol)
        if len(self.symbols) > BATCH_ROWS:
            self.symbols = ["".join(self.symbols)]

    def row(self):
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.key, gaps, *self.faults.values(), self.illegal, "".join(self.symbols)


def _flushed(rows: Iterator[tuple], schema: pa.Schema, chars: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches, ended by the number of rows or by the size of column `chars`."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[chars])
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _schemas(df: DataFrame, ddl: str) -> tuple[str, pa.Schema]:
    """A result of conv_id, of the type it has in df, and of ddl's longs and strings: for Spark and for Arrow."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))]
    return f"conv_id {dict(df.dtypes)['conv_id']}, {ddl}", pa.schema([("conv_id", to_arrow_type(df.schema["conv_id"].dataType)), *fields])


def signed(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, counts of faults and of illegal neighbours, signature."""
    rows = marked(turns)
    rows = rows.sortWithinPartitions("conv_id", *_ORDER).select("conv_id", "turn", "initial", "fault", "symbol")
    ship(rows.sparkSession)
    ddl, schema = _schemas(rows, _SIGNED)

    def run(batches):
        def conversations():
            now = None
            for key, turn, initial, fault, symbol in _opened(batches):
                if now is None or key != now.key:
                    if now:
                        yield now.row()
                    now = _Signed(key)
                now.add(turn, initial, fault, symbol)
            if now:
                yield now.row()

        yield from _flushed(conversations(), schema, 6)

    return rows.mapInArrow(run, ddl)


def _moves(state: int, symbol: str) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of a turn met in a state."""
    yield "D", DELETE, state
    if symbol == "x":
        return
    more = TRUNCATED if symbol.isupper() else 0
    yield "R", REROLE + more, NEXT_TURN[state]
    if (to := KEPT[symbol.lower()].get(state)) is not None:
        yield "K", KEEP + more, to


#: The layer before any turn: (cost above the least, rank) of each state, None where it can't be.
ROOT = ((0, 0), None, None, None)


@cache
def step(layer: tuple, symbol: str) -> tuple[tuple, int, tuple]:
    """The layer after a turn, what its least cost adds, and per state (state before, edits between)."""
    best: dict[int, tuple] = {}
    for state, entry in enumerate(layer):
        if entry is None:
            continue
        cost, rank = entry
        now = state
        for inserts in range(MOST_INSERTS + 1):
            for edit, price, to in _moves(now, symbol):
                found = (cost + inserts * INSERT + price, rank, "I" * inserts + edit, state)
                if to not in best or found < best[to]:
                    best[to] = found
            now = NEXT_TURN[now]
    least = min(x[0] for x in best.values())
    best = {to: x for to, x in best.items() if x[0] - least <= PRUNE}
    ranks = {x: i for i, x in enumerate(sorted(x[1:3] for x in best.values()))}
    after = tuple((best[s][0] - least, ranks[best[s][1:3]]) if s in best else None for s in range(4))
    return after, least, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))


@cache
def ending(layer: tuple) -> tuple[int, int, str]:
    """(cost above the layer's least, state, edits) of the cheapest end that leaves a whole conversation or none."""
    found = []
    for state, entry in enumerate(layer):
        if entry is not None:
            now = state
            for inserts in range(MOST_INSERTS + 1):
                if now in (START, A):
                    found.append((entry[0] + inserts * INSERT, entry[1], "I" * inserts, state))
                now = NEXT_TURN[now]
    cost, _, edits, state = min(found)
    return cost, state, edits


class Trie:
    """The path of the trie that the last signature ended; signatures have to come sorted."""

    def __init__(self):
        self.signature, self.layers, self.costs, self.backs, self.made = "", [ROOT], [0], [None], 0

    def answer(self, signature: str) -> tuple[int, str]:
        """Cost and edits of the cheapest repair."""
        shared = len(os.path.commonprefix([self.signature, signature]))
        del self.layers[shared + 1 :], self.costs[shared + 1 :], self.backs[shared + 1 :]
        for symbol in signature[shared:]:
            layer, least, back = step(self.layers[-1], symbol)
            self.layers.append(layer)
            self.costs.append(self.costs[-1] + least)
            self.backs.append(back)
            self.made += 1
        self.signature = signature
        cost, state, last = ending(self.layers[-1])
        edits = [last]
        for back in reversed(self.backs[1:]):
            state, some = back[state]
            edits.append(some)
        return self.costs[-1] + cost, "".join(reversed(edits))


def answers(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit of the distinct signatures."""
    sorted_ones = signatures.select("signature").distinct()
    sorted_ones = sorted_ones.repartitionByRange("signature").sortWithinPartitions("signature")
    ship(signatures.sparkSession)
    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])

    def run(batches):
        trie = Trie()
        yield from _flushed(((s, *trie.answer(s)) for (s,) in _opened(batches)), schema, 2)

    return sorted_ones.mapInArrow(run, "signature string, cost long, audit string")


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation of turns (see damage and whole): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. A stored table."""
    told = stored(signed(turns), "signed")
    return stored(told.join(answers(told), "signature").drop("signature"), "audits")


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, position, role, text) of repaired conversations from rows (conv_id, audit or null, role, text), the audit's row first."""
    key, audit, at, state, place = None, "", 0, START, 0

    def inserts():
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            state = NEXT_TURN[state]
            yield key, place, "user" if state == U else "assistant", ""
            at, place = at + 1, place + 1

    for conv, edits, role, text in rows:
        if edits is not None:
            key, audit, at, state, place = conv, edits, 0, START, 0
            yield from inserts()
            continue
        edit, at = audit[at], at + 1
        if edit == "R":
            state = NEXT_TURN[state]
            role = "user" if state == U else "assistant"
        elif edit == "K":
            state = KEPT[role[0]][state]
        if edit != "D":
            yield key, place, role, text
            place += 1
        yield from inserts()


def repair(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, position, role, text of the repaired conversations, in order within each partition, a conversation in one partition."""
    rows = _keyed(turns.filter("not dropped")).select("conv_id", F.lit(1).alias("part"), *_ORDER, F.lit(None).cast("string").alias("audit"), "text")
    heads = audited.select("conv_id", F.lit(0).alias("part"), *[F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in _ORDER], "audit", F.lit(None).cast("string").alias("text"))
    line = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "part", *_ORDER).select("conv_id", "audit", "role", "text")
    ship(turns.sparkSession)
    ddl, schema = _schemas(line, "position long, role string, text string")
    return line.mapInArrow(lambda batches: _flushed(_edited(_opened(batches)), schema, 3), ddl)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of what repair() returns: `role:text` of its turns, joined by newlines."""
    ship(repaired.sparkSession)
    ddl, schema = _schemas(repaired, "repaired_sha256 string")

    def hashed(batches):
        key, state = None, None
        for conv, place, role, text in _opened(batches):
            if place == 0:
                if state:
                    yield key, state.hexdigest()
                key, state = conv, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if state:
            yield key, state.hexdigest()

    return repaired.mapInArrow(lambda batches: _flushed(hashed(batches), schema, 1), ddl)


def structure_report(turns: DataFrame) -> DataFrame:
    """audits() of the turns with the digest of each repaired conversation."""
    told = audits(turns)
    empty = hashlib.sha256(b"").hexdigest()
    found = digests(repair(turns, told)).withColumnRenamed("conv_id", "of_conv")
    met = told.join(found, F.col("conv_id").eqNullSafe(F.col("of_conv")), "left")
    return met.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
