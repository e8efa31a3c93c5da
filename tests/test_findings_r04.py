"""Small tests for the finding of the fourth round."""

import os
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.functions import text
from millrace.functions.similarity import Evidence
from millrace.operators import grounding

FOLDER = "/root/testdata/sf0.001"


def made(rng, words, n):
    one = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 6))) + rng.choice([".", ""])
    answers = [(rng.choice([i, i, i - 1]), one()) for i in range(n)] + [(None, "goa. fort"), (n, None), (n + 1, " ")]
    evidence = [(i, one()) for i, _ in answers for _ in range(rng.randint(0, 3))] + [(i, t) for i, t in answers[::4]]
    return answers, evidence


@pytest.mark.parametrize("sequence", [True, False])
def test_verdicts_are_the_rolled_up_scores(spark, sequence):
    answers, evidence = made(random.Random(sequence), "goa beach temple fort market river 12 99 the of किला".split(), 80)
    frames = lambda: (spark.createDataFrame(answers, "answer_id long, answer string"), spark.createDataFrame(evidence, "answer_id long, text string"))
    found = {}
    for threshold in (0.55, 0.2):
        want = sorted(map(tuple, grounding.roll_up(grounding.claim_scores(*frames(), sequence), threshold).collect()), key=str)
        got = sorted(map(tuple, grounding.verify(*frames(), sequence, threshold).collect()), key=str)
        assert got == want and len(got) > 40
        found |= {row[2]: row for row in got}
    assert set(found) == {"grounded", "flagged"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_full_grounding_shuffles_no_scores(spark):
    found = entry.queries()["grounding_full"](spark, FOLDER)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scores = grounding.claim_scores(docs.selectExpr("doc_id AS answer_id", "text AS answer"), docs.selectExpr("doc_id - 1 AS answer_id", "text"))
    want = sorted(map(tuple, grounding.roll_up(scores).collect()))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100


def test_pieces_that_are_given_up_count(monkeypatch):
    """Evidence in pieces beyond what an answer keeps: same scores and verdicts, and little is held."""
    rng, words = random.Random(3), "goa beach temple fort market river hill quay".split()
    for _ in range(40):
        own = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 8))]
        pieces = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(6)]
        kept = []
        for held in (16 << 20, 200, 0):
            monkeypatch.setattr(grounding, "HELD_CHARS", held)
            answer = grounding._Answer(1, True)
            answer.ask(*["\n".join(own)] * 3, "\n" * (len(own) - 1))
            for x in pieces:
                answer.meet(x, x, "")
                assert len(answer.pieces) == 1 or sum(len(t) for t, _ in answer.pieces) <= held
            scores = [r[3] for r in answer.rows()]
            kept.append((scores, answer.verdict(0.6)))
            low = [c for c, x in zip(own, scores, strict=True) if x < 0.6]
            assert kept[-1][1][0][2:] == ("flagged" if low else "grounded", pytest.approx(min(scores) if low else sum(scores) / len(scores), abs=1e-15), low)
        assert kept[0] == kept[1] == kept[2]


def test_few_claims_are_compared(monkeypatch):
    """Of claims that the evidence's words refute or hold, none is aligned but those that may have the least score."""
    seen, ratio = [], Evidence.ratio
    monkeypatch.setattr(Evidence, "ratio", lambda self, claim: seen.append(claim) or ratio(self, claim))
    own = [*(f"here are words number{i} and other{i} too" for i in range(200)), "nothing shared at all"]
    answer = grounding._Answer(1, True)
    answer.ask("\n".join(own), "\n".join(own), "\n".join(own), "\n" * (len(own) - 1))
    held = " ".join(own[:100]) + " words, here"
    answer.meet(held, held, "")
    rows = answer.rows()
    assert len(seen) == len(own)
    seen.clear()
    ((_, n, verdict, score, flagged),) = answer.verdict(0.55)
    assert (n, verdict, score) == (201, "flagged", min(r[3] for r in rows)) and flagged == [r[2] for r in rows if r[3] < 0.55]
    assert len(seen) < 10


def test_texts_are_composed_and_normalised_as_before(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab \t\n\r  é˿́eÅ가\x0b किZ9٣") for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "a", "é", "˿", "Å"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string").select("i", "x", text.nfc(F.col("x")).alias("nfc"), text.normalize(F.col("x")).alias("normal"), text.substantive_tokens(F.col("x")).alias("tokens"))
    for r in rows.collect():
        if r.x is None:
            assert (r.nfc, r.normal, r.tokens) == (None, "", None)
            continue
        composed = unicodedata.normalize("NFC", r.x)
        assert r.nfc == composed and r.normal == re.sub(" +", " ", re.sub("[\t\n\r]", " ", composed)).strip()
        found = re.findall("[a-zA-Z0-9ऀ-ൿ]{2,}|[0-9०-९]", r.x.lower())
        assert r.tokens == [w for w in dict.fromkeys(found) if w not in text.STOP_WORDS]
