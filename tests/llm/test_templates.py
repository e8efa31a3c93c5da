import random

import pytest

from millrace.llm import templates as T

ITEM = "Tom has 5 apples and he gives 3 apples to Anna before lunch, then Tom buys 12 more apples at the market with Anna."
SAME = "So Peter has 7 apples and he gives 2 apples to Mary before lunch, then Peter buys 44 more apples at the market with Mary."
OTHER = "So Peter has 7 apples and he gives 2 apples to Mary before lunch, then John buys 44 more apples at the market with Lisa."
DOCS = "doc_id long, text string, h int, row string, id int, slots int, total int"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, 1, "r", 2, 3, 4) for i, t in enumerate(texts)], DOCS)


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_new_parameters_are_seen_through_and_mixed_ones_are_not(spark):
    found = T.leaks(docs(spark, SAME, OTHER, ITEM, None, "", "nothing of the kind"), items(spark, ITEM)).collect()
    assert {(r.doc_id, r.exact) for r in found} == {(0, False), (2, True)}


def test_exact_passages_by_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    passage = lambda n: " ".join(rng.choice(words) for _ in range(n))
    known = [passage(rng.randint(9, 40)) for _ in range(20)]
    texts, true = [], set()
    for i in range(60):
        text = passage(rng.randint(0, 80))
        if i % 3 == 0:
            k = rng.randrange(20)
            text, _ = f"{text} {known[k]} {passage(30)}", true.add((i, k))
        texts.append(text)
    found = T.leaks(docs(spark, *texts), items(spark, *known)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == true
    assert all(r.n_windows <= r.item_windows and 0 < r.coverage <= 1 for r in found)


def test_defined_cases(spark):
    twice = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, SAME)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.exact) for r in T.leaks(twice, items(spark, ITEM, None, "")).collect()) == [(0, False), (1, True), (1, True)]
    assert T.leaks(twice.limit(0), items(spark, ITEM)).count() == 0
    assert T.leaks(twice, items(spark, ITEM).limit(0)).count() == 0
    short = T.leaks(docs(spark, "what is a short way", "what is a short day"), items(spark, "What is a short way?"))
    assert [r.doc_id for r in short.collect()] == [0]
    long = T.leaks(docs(spark, "filler words go here " * 20_000 + ITEM), items(spark, ITEM))
    assert long.count() == 1


def test_leaking_rows_go_and_columns_stay(spark):
    kept = T.without_leaks(docs(spark, SAME, "clean text here", None), items(spark, ITEM))
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [1, 2]
    assert kept.columns == [x.split()[0] for x in DOCS.split(", ")]


@pytest.mark.parametrize("text,kinds", [("We saw Anna Smith today", [0, 0, 2, 0]), ("It cost 5 dollars", [0, 0, 1, 3]), ("twenty km", [1, 3]), ("NASA is BIG", [0, 0, 0])])
def test_slots(text, kinds):
    import pyarrow as pa

    from millrace.llm.words import words_of

    assert T.templates_of(words_of(pa.array([text]))).kinds.tolist() == kinds


def test_every_copy_is_judged_by_itself(spark):
    gap = " " + "filler words go here " * 20
    close = "So Peter has 4 apples and he gives 4 apples to Mary before lunch, then Peter buys 44 more apples at the market with Mary."
    third = SAME.replace("Peter", "Henry").replace("7", "9").replace("Mary", "Jane")
    texts = [f"Now {ITEM}{gap}{SAME}", f"{SAME}{gap}Now {ITEM}", f"{SAME} {third}", close, f"{OTHER}{gap}{OTHER}", f"Now {ITEM}{gap}Then Eve gives 3 apples to Anna before lunch, then Tom buys 8 more"]
    found = {r.doc_id: r for r in T.leaks(docs(spark, *texts), items(spark, ITEM)).collect()}
    assert {i: r.exact for i, r in found.items()} == {0: True, 1: True, 2: False, 3: False, 5: True}
    assert all(r.slot_consistency >= T.CONSISTENCY and r.coverage >= T.COVERAGE for r in found.values())
