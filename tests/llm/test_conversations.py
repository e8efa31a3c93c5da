"""Repair of conversations against an exhaustive search over edits."""

import hashlib
import itertools
import os
import random
import re
import zlib
from functools import cache

import pytest

from millrace.llm import conversations as C

FOLDER = "/root/testdata/sf0.01"


def cheapest(signature):
    """(cost, audit) by search over all edits, with whole strings."""

    @cache
    def best(i, state, left):
        found, turn = [], {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if i == len(signature):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            x, moves = signature[i], [("D", 3, state)]
            if x != "x":
                moves.append(("R", 2 + x.isupper(), turn))
                if x.lower() == turn or (x.lower() == "s" and state == ""):
                    moves.append(("K", int(x.isupper()), x.lower()))
            for edit, cost, to in moves:
                c, rest = best(i + 1, to, 4)
                found.append((cost + c, edit + rest))
        if left:
            c, rest = best(i, turn, left - 1)
            found.append((2 + c, "I" + rest))
        return min(found, default=(10**9, ""))

    for i in range(len(signature), 0, -50):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 4)
    return best(0, "", 4)


def test_answers_are_the_cheapest_and_least():
    trie, rng = C.Trie(), random.Random(3)
    small = ["".join(x) for n in range(4) for x in itertools.product("suaoxSUAO", repeat=n)]
    large = ["".join(rng.choice("suaoxSUAO" + "uaua" * 4) for _ in range(rng.randint(4, 30))) for _ in range(1500)]
    signatures = sorted(set(small + large))
    for s in signatures:
        assert trie.answer(s) == cheapest(s), s
    prefixes = {s[:n] for s in signatures for n in range(1, len(s) + 1)}
    assert trie.made == len(prefixes)  # each node of the trie once


def brute(rows):
    """The whole report from Python rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        for copy in range(1 + (kind == 3)):
            mine.append(((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), copy), turn, role, text))
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda x: x[0])
        seen, counts, signature = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, ""
        for _, _, role, text in mine:
            left = re.sub("[\x20\x09-\x0d]+$", "", text)
            fault = "blank" if not re.search("[^\x20\x09-\x0d]", text) else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
            seen.add((role, text))
            kind = role[0] if role[:1] in ("s", "u", "a") and role else "o"
            if fault:
                counts[fault] += 1
            signature += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        turns = [t for _, t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit = cheapest(signature)
        state, lines, i = "", [], 0
        for edit in audit:
            turn = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            name = {"u": "user", "a": "assistant"}[turn]
            if edit == "I":
                lines.append(f"{name}:")
                state = turn
                continue
            _, _, role, text = mine[i]
            i += 1
            if edit == "K":
                lines.append(f"{role}:{text}")
                state = role[0]
            elif edit == "R":
                lines.append(f"{name}:{text}")
                state = turn
        assert i == len(mine)
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_dict(df):
    rows = df.collect()
    found = {r[0]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_against_brute_force(spark):
    from millrace.llm.queries import op13_conversation_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op13_conversation_repair(spark, FOLDER)
    assert got.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert as_dict(got) == brute(rows)


def test_nulls_ties_repeats_and_long_conversations(spark):
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Fine.", "Cut off", "", None, " \t\n", "é?", "Done! \n", "a" * 100_000 + "."]
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randint(1, 9))]
    rows += [(100, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(2000)]
    rows += rows[:20]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copy int, audit string")
    assert as_dict(C.structure_report(C.damage(df))) == brute(rows)


def test_conversations_without_turns_and_an_empty_table(spark):
    gone = [(c, t) for c in range(200) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    df = spark.createDataFrame([(c, t, "user", "Hi.") for c, t in gone], "conv_id long, turn long, role string, text string")
    got = as_dict(C.structure_report(C.damage(df)))
    assert got == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, _ in gone}
    assert C.structure_report(C.damage(df.limit(0))).count() == 0


def test_repair_returns_the_turns(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hello."), ("a", 1, "user", "Again."), ("b", 0, "assistant", "Well."), ("c", 0, "user", " ")], "conv_id string, turn int, role string, text string")
    turns = C.whole(df)
    told = C.audits(turns)
    assert {r.conv_id: (r.cost, r.audit) for r in told.collect()} == {"a": (2, "KR"), "b": (2, "IK"), "c": (3, "D")}
    assert sorted(map(tuple, C.repair(turns, told).collect())) == [("a", 0, "user", "Hello."), ("a", 1, "assistant", "Again."), ("b", 0, "user", ""), ("b", 1, "assistant", "Well.")]
