import itertools
import random
import re

import pytest

from millrace.llm import graph
from millrace.llm import ngram_join as J
from millrace.llm.graph import components


def grams(text, n=5):
    w = re.findall(r"[a-z0-9]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(texts, t=0.8):
    """class (least index) and links per distinct text."""
    names = sorted(set(texts), key=texts.index)
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, sets = dict.fromkeys(names, 0), {x: grams(x) for x in names}
    for a, b in itertools.combinations(names, 2):
        common = len(sets[a] & sets[b])
        if common and common >= t * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
            links[a] += 1
            links[b] += 1
            ra, rb = sorted((find(a), find(b)), key=texts.index)
            parent[rb] = ra
    return {x: (texts.index(find(x)), links[x], texts.count(x)) for x in names}


def corpus(seed=4):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(500)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts += [" ".join(own)] * rng.choice([1, 1, 2])
    texts += ["", "a b", "A b!", "one two three four five", "one two three four five"]
    return texts


@pytest.mark.parametrize("windows,most,parts", [(400_000, 1_000, 8), (300, 4, 8), (300, 4, 0)])
def test_classes_and_links_by_brute_force(spark, monkeypatch, windows, most, parts):
    monkeypatch.setattr(J, "MOST_PARTS", parts)
    monkeypatch.setattr(graph, "BROADCAST_LIMIT", 24 << 20 if parts else 0)
    monkeypatch.setattr(J, "BLOCK_WINDOWS", windows)
    monkeypatch.setattr(J, "BLOCK_TEXTS", most)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, digest string, root int, block int")
    want = brute(texts)
    found = J.jaccard_classes(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        assert (r.class_id, r.n_links, r.n_copies) == want[texts[r.doc_id]], texts[r.doc_id]


def test_one_of_each_class_stays(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _, _ in brute(texts).values()})


def test_defined_cases(spark):
    long = " ".join(f"z{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "same words here"), (3, "same words here"), (None, "same words here"), (None, "alone in the world"), (8, long), (9, long + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in J.jaccard_classes(docs).collect()}
    assert found == {(1, 1, 0, 2), (2, 1, 0, 2), (3, 3, 0, 3), (None, 3, 0, 3), (None, None, 0, 1), (8, 8, 1, 1), (9, 8, 1, 1)}
    assert sorted((r.doc_id or 0) for r in J.one_of_each(docs).collect()) == [0, 1, 3, 8]
    assert J.jaccard_classes(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.95):
        bands, rows = J.choose_bands(t, 0.99)
        assert 1 - (1 - t**rows) ** bands >= 0.99 and bands * rows <= 128
    assert J.choose_bands(1.0, 0.999)[0] == 1


@pytest.mark.parametrize("limit", [24 << 20, 0])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "BROADCAST_LIMIT", limit)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    nodes = {x for a, b in edges for x in (a, b) if a != b}
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == {(x, find(x)) for x in nodes}
    assert len(found) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
