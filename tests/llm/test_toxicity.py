import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import toxicity as T
from millrace.llm.words import prefixes, words_of

BAD = ["stupid", "worthless", "idiot", "pathetic"]
SCHEMA = "doc_id long, text string, key string, row int, score string"


def rows(n=600, seed=3):
    rng = random.Random(seed)
    parts = ["st", "wor", "id", "pa", "the", "tic", "less", "ly", "an", "er", "on", "iot", "upid", "th", "or", "in"]
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    vocabulary = [w for w in vocabulary if w not in BAD]
    out, marks = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        out.append((i, " ".join(words), "k", 1, "s"))
        marks.append((i, 1, toxic))
    return out, marks


@pytest.fixture(scope="module")
def model(spark):
    docs, marks = rows()
    return T.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))


def test_held_out_rows_are_judged_well(spark, model):
    docs, marks = rows()
    found = {r.doc_id: r for r in T.score(spark.createDataFrame(docs, SCHEMA), model).collect()}
    for doc_id, _, toxic in marks:
        assert found[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert found[doc_id].predicted == toxic == int(found[doc_id].score >= 0.7)


@pytest.mark.parametrize("text", ["you are 1d10t", "so stuuuupid", "w0rthl3ss thing", "p@th3tic", "$tup1d", "i d i o t", "s.t.u.p.i.d", "w-o-r-t-h-l-e-s-s", "st*pid", "STUPID!!!", "idi0t,", "a i_d_i_o_t b"])
def test_disguises_are_read(spark, model, text):
    clean = "the an er on in ly " * 5
    (found,) = T.score(spark.createDataFrame([(1, clean + text + " " + clean)], "doc_id long, text string"), model).collect()
    assert found.predicted == 1


def test_defined_cases(spark, model):
    long = "the an er on " * 50_000
    given = [(1, None), (2, ""), (3, " \n "), (None, "stupid idiot"), (5, "thing"), (5, "thing"), (6, long), (7, long + " idiot"), (8, "a " * 5000), (9, "1 2 3 555 +1 (603) 555-8791 mail.05@mail2.example.com")]
    found = T.score(spark.createDataFrame(given, "doc_id long, text string"), model).collect()
    assert len(found) == len(given) and all(0 <= r.score <= 1 for r in found)
    assert {r.doc_id: r.predicted for r in found} == {1: 0, 2: 0, 3: 0, None: 1, 5: 0, 6: 0, 7: 1, 8: 0, 9: 0}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.score(empty, model).count() == 0


def test_without_labels_and_documents(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = T.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert T.score(docs, none).first().predicted == 0
    T.fit(docs.limit(0), spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int"))


def test_rejected_rows_go_and_columns_stay(spark, model):
    docs = spark.createDataFrame([(1, "an idiot", "x", 1, "s"), (2, "a thing", "y", 2, "t"), (3, None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in T.without_toxic(docs, model).orderBy("doc_id").collect()] == [(2, "a thing", "y", 2, "t"), (3, None, None, None, None)]


def test_decoder_finds_the_cheapest_reading():
    rng = np.random.default_rng(1)
    costs = rng.random((28, 28, 28)) * 5
    decoder = T.Decoder(costs)

    def price(text):
        a = b = 0
        total = 0.0
        for x in text + " ":
            c = 0 if x == " " else ord(x) - 96 if "a" <= x <= "z" else 27
            if c or b:
                total += costs[a][b][c]
                a, b = (0, 0) if c == 0 else (b, c)
        return total

    for chunk in ("1d10t", "s-tt", "a.b", "aaab"):
        paths = [(0.0, "")]
        for options in T.lattice(chunk):
            paths = [(c + p, t + x) for c, t in paths for x, p in options]
        best = min(c + price(t) for c, t in paths)
        got = decoder.read(chunk)
        assert min(c + price(t) for c, t in paths if t == got) == pytest.approx(best)


def test_clean_words_are_not_lattices():
    w = words_of(pa.array(["plain words, and more. thing$$$ stuff*** AND!! (good) well-known"]))
    assert T.disguised(w)[0] in ([], ["well-known"])


@pytest.mark.parametrize(
    "text",
    [
        "th3_@n_er_on_the_@n_er_on_the_an_er_on_the_@n_er_on_the_an_er_on_stup1d_the_an",
        "idi" + "o" * 90 + "t",
        "1234567890-1234567890-stup1d",
        "the" + "-12345-the" * 9 + "-1d10t-the",
        "t h e a n e r s t u p i d t h e o n",
        "t h e a n e r o n t h e a n e r o n t h e a n e r o n t h e a n e r o n t h e s t u p i d",
    ],
)
def test_long_disguises_are_read(spark, model, text):
    clean = "the an er on in ly " * 5
    found = {r.doc_id: r for r in T.score(spark.createDataFrame([(1, f"{clean}{text} {clean}")], "doc_id long, text string"), model).collect()}
    assert found[1].predicted == 1


def features(text, decoder):
    """Hashes of the words, readings and beginnings of a text, one by one."""
    found = re.findall(r"[0-9a-z]+", text.lower())
    read = [x for chunk in T.disguised(words_of(pa.array([text])))[0] for x in decoder.words(chunk)]
    out = Counter()
    for w in found + read:
        own = words_of(pa.array([w]))
        out[int(own.hashes[0])] += 1
        for k in (4, 5, 6, 7):
            if len(w) > k:
                out[int(prefixes(own, (k,))[0][0])] += 1
    return out, len(found)


def test_marks_by_brute_force(model):
    docs, marks = rows()
    decoder, toxic, clean = T.Decoder(model.costs), Counter(), Counter()
    kind = {i: t for i, _, t in marks if zlib.crc32(str(i).encode()) % 3 != 1}
    for i, text, *_ in docs:
        if i in kind:
            (toxic if kind[i] else clean).update(set(features(text, decoder)[0]))
    n_toxic, n = sum(kind.values()), len(kind)
    want = set()
    for x, a in toxic.items():
        b = clean[x]
        g = 2 * (a * math.log(a / ((a + b) * n_toxic / n)) + (b * math.log(b / ((a + b) * (n - n_toxic) / n)) if b else 0))
        if a >= 4 and a >= 0.5 * (a + b) and a > (a + b) * n_toxic / n and g >= 4.5**2:
            want.add(x)
    assert set(model.marks.tolist()) == want


def test_scores_by_brute_force(spark, model):
    docs, _ = rows(120, seed=8)
    texts = [t for _, t, *_ in docs] + ["you are 1d10t and p@th3tic", "", "i d i o t", "the s.t.u.p.i.d an-er 5tup1d stuuupid"]
    decoder, at = T.Decoder(model.costs), {int(h): i for i, h in enumerate(model.marks)}
    found = T.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in found:
        counts, words = features(texts[r.doc_id], decoder)
        held = {at[h]: n for h, n in counts.items() if h in at}
        odds = model.base + sum(model.weights[i] for i in held) + model.weights[-1] * math.log1p(1000 * sum(held.values()) / max(words, 100))
        want = max([1 / (1 + math.exp(-odds)), *(model.sure[i] for i in held)])
        assert r.score == pytest.approx(want, abs=1e-9)


def test_labels_that_disagree_make_a_row_toxic(spark):
    docs, marks = rows()
    twice = marks + [(i, 1, 1 - t) for i, _, t in marks[:50]]
    given = spark.createDataFrame(docs, SCHEMA)
    once = [(i, q, 1 if i < 50 else t) for i, q, t in marks]
    kind = "doc_id long, quality int, toxic int"
    one, two = (T.fit(given, spark.createDataFrame(x, kind)) for x in (twice, once))
    assert np.array_equal(one.marks, two.marks) and np.allclose(one.weights, two.weights)
