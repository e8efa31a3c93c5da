"""Support of claims as a set join: against a plain loop, and in time that grows with the claims."""

import difflib
import os
import random
import re
import time

import pytest

from millrace.functions.text import STOP_WORDS
from millrace.operators import grounding

FOLDER = "/root/testdata/sf0.01"


def words(text):
    return {w for w in re.findall("[a-zA-Z0-9ऀ-ൿ]+", text.lower()) if w not in STOP_WORDS and len(w) > 1 or re.fullmatch(r"\d+", w)}


def figures(text):
    return set(re.findall(r"\b\d+(?:\.\d+)?\b", text.lower()))


def brute(claim, texts, sequence):
    mine = words(claim)
    if figures(claim) - set().union(set(), *map(figures, texts)):
        return 0.0
    if not mine:
        return float(any(claim.lower() in t.lower() for t in texts))
    def pair(t):
        if not words(t):
            return 0.0
        share = len(mine & words(t)) / len(mine)
        return 0.7 * share + 0.3 * difflib.SequenceMatcher(None, claim.lower(), t.lower()).ratio() if sequence else share
    return max(map(pair, texts), default=0.0)


def test_full_scores_of_real_texts(spark):
    """Whole documents as answers, their neighbours and changed copies as evidence; the library's matcher compares all pairs."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect() if r.text} if os.path.isdir(FOLDER) else {}
    if not docs:
        pytest.skip("no test tables")
    rng = random.Random(4)
    chosen = sorted((i for i in docs if i + 1 in docs and len(docs[i]) < 2500 and len(docs[i + 1]) < 2500))[:60]
    normal = lambda t: re.sub(" +", " ", re.sub("[\t\n\r]", " ", t)).strip()
    evidence = []
    for i in chosen:
        parts = docs[i].split(" ")
        rng.shuffle(parts)
        evidence += [(i, docs[i + 1]), (i, " ".join(parts)), (i, docs[i][: len(docs[i]) // 2])]
    texts = {i: [normal(t) for j, t in evidence if j == i and normal(t)] for i in chosen}
    rows = grounding.claim_scores(spark.createDataFrame([(i, docs[i]) for i in chosen], "answer_id long, answer string"), spark.createDataFrame(evidence, "answer_id long, text string")).collect()
    assert len(rows) > 500
    for r in rows:
        assert r.score == pytest.approx(brute(r.claim, texts[r.answer_id], True)), r.claim


@pytest.mark.parametrize("sequence", [False, True])
def test_defined_cases(spark, sequence):
    answers = [(1, "Goa has 12 forts. The of. 7. Zebra!"), (2, "Goa."), (3, ""), (4, None), (5, "é. of."), (None, "Goa."), (6, "Goa 12. Goa 12.")]
    evidence = [(1, "goa has 12 forts and the of"), (1, "goa has 12 forts and the of"), (1, "zebra"), (1, ""), (1, None), (9, "unasked"), (5, "é of. x"), (6, "goa"), (6, "12")]
    rows = grounding.claim_scores(spark.createDataFrame(answers, "answer_id long, answer string"), spark.createDataFrame(evidence, "answer_id long, text string"), sequence).collect()
    found = {(r.answer_id, r.claim_no): r for r in rows}
    assert len(found) == len(rows) == 4 + 1 + 2 + 1 + 2
    for (i, _), r in found.items():
        texts = [re.sub(" +", " ", t).strip() for j, t in evidence if j == i and i is not None and t]
        assert r.score == pytest.approx(brute(r.claim, texts, sequence)), r


def test_time_grows_with_the_claims_of_one_document(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(5000)]
    took = []
    for n in (500, 4000, 16000):
        text = ". ".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(n)) + "."
        one = lambda name, text=text: spark.createDataFrame([(1, text)], f"answer_id long, {name} string")
        start = time.perf_counter()
        assert grounding.claim_scores(one("answer"), one("text"), sequence=False).filter("score = 1").count() == n
        took.append(time.perf_counter() - start)
    assert took[2] < 6 * took[1]  # four times the claims; sixteen times where each meets the whole text
