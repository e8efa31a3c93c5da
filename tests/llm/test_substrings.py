import random

import numpy as np
import pytest

from millrace.llm import substrings as S

SCHEMA = "doc_id long, text string, seed int, place int, src string, ask int"


def test_chain_scores_by_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        links = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(1, 25))})
        here, there = (np.array(x) for x in zip(*links))
        best = [S.SEED_WEIGHT] * len(links)
        for j, (p, q) in enumerate(links):
            for i, (a, b) in enumerate(links[:j]):
                if a < p and b < q:
                    best[j] = max(best[j], S.SEED_WEIGHT + best[i] - S.GAP_COST * (p - a + q - b))
        chains = S.chain(here, there)
        first = chains[0]
        got = S.SEED_WEIGHT * len(first) - S.GAP_COST * sum((here[b] - here[a]) + (there[b] - there[a]) for a, b in zip(first, first[1:]))
        assert got == pytest.approx(max(best))
        assert sorted(x for c in chains for x in c) == list(range(len(links)))
        assert all(here[a] < here[b] and there[a] < there[b] for c in chains for a, b in zip(c, c[1:]))


def test_minimisers_cover_every_stretch():
    rng = np.random.default_rng(2)
    hashes, first = rng.integers(0, 2**63, 400, dtype=np.uint64), np.array([0, 150, 160, 400])
    _, owner, place = S.minimisers(hashes, first, 6, 10)
    for t in range(3):
        own, n = set(place[owner == t].tolist()), first[t + 1] - first[t]
        for i in range(n - 14):
            assert own & set(range(i, i + 10))
        assert all(p + 6 <= n for p in own)


def test_walk_reads_through_edits():
    a = np.arange(100, dtype=np.uint32)
    b = np.concatenate((a[:30], [1000, 1001], a[32:60], a[61:]))
    i, j, matches = S.walk(a, b)
    assert (i, j, matches) == (100, 99, 97)
    assert S.walk(a, a + 1000) == (0, 0, 0)


def planted(seed=3, edits=0.03):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, spans = [], []
    for p in range(12):
        passage = [word() for _ in range(rng.randint(55, 80))]
        for c in range(rng.randint(2, 5)):
            own = [word() if rng.random() < edits else w for w in passage]
            before, after = [word() for _ in range(rng.randint(0, 60))], [word() for _ in range(rng.randint(0, 60))]
            rows.append((p * 10 + c, " ".join(before + own + after)))
            spans.append((p * 10 + c, len(before), len(before) + len(own), c))
    return rows + [(1000 + i, " ".join(word() for _ in range(100))) for i in range(20)], spans


@pytest.mark.parametrize("hot", [S.HOT_SEED, 1])
def test_planted_passages_are_found_and_clean_rows_left_alone(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_SEED", hot)
    monkeypatch.setattr(S, "HOT_SAMPLE", 1.0 if hot == 1 else S.HOT_SAMPLE)
    monkeypatch.setattr(S, "LEAST_SALTS", 2)
    rows, spans = planted()
    docs = spark.createDataFrame([(i, t, 1, 2, "s", 3) for i, t in rows], SCHEMA)
    found = {r.doc_id: r for r in S.repeated_passages(docs).collect()}
    assert set(found) == {i for i, _, _, c in spans if c}
    for i, lo, hi, c in spans:
        if c:
            assert abs(found[i].start_word - lo) <= 8 and abs(found[i].end_word - hi) <= 8
            assert found[i].src_doc_id < i and found[i].src_doc_id // 10 == i // 10


def test_cut(spark):
    rows, spans = planted(edits=0)
    docs = spark.createDataFrame([(i, t, 7, 2, "s", 3) for i, t in rows], SCHEMA)
    passages = S.repeated_passages(docs)
    kept = S.without_passages(docs, passages)
    texts, found = {r.doc_id: r.text for r in kept.collect()}, {r.doc_id: r for r in passages.collect()}
    assert kept.columns == docs.columns
    for i, t in rows:
        words = t.split()
        left = words[: found[i].start_word] + words[found[i].end_word :] if i in found else words
        assert texts.get(i, "").split() == left
        assert (i in texts) == bool(left)


def test_defined_cases(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"q{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (None, passage), (None, passage), (3, passage), (3, passage), (4, "short text"), (5, "short text"), (6, passage + " " + passage), (7, f"{long} {passage.upper()}"), (8, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = S.repeated_passages(docs)
    assert {(r.doc_id, r.src_doc_id) for r in found.collect()} >= {(6, 3), (7, 3), (8, 7)}
    assert {r.doc_id for r in found.collect()} == {6, 7, 8}
    kept = sorted((r.doc_id or 0) for r in S.without_passages(docs, found).collect())
    assert kept == [0, 0, 1, 2, 3, 3, 4, 5, 7]
    assert S.repeated_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("gap", [33, 64, 100])
def test_passages_behind_a_gap_of_other_words_are_found(spark, gap):
    one, two = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    rows = [(d, " ".join([*one, *(f"g{d}x{i}" for i in range(gap)), *two])) for d in (1, 2)]
    found = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.src_doc_id, r.src_start_word, r.src_end_word) for r in found) == [
        (2, 0, 200, 1, 0, 200),
        (2, 200 + gap, 400 + gap, 1, 200 + gap, 400 + gap),
    ]


def test_passages_whose_sentences_earlier_documents_hold_are_found(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for p in range(30):
        sentences = [[f"p{p}s{s}w{rng.randrange(10**6)}" for _ in range(15)] for s in range(4)]
        filler = lambda: [f"f{rng.randrange(10**9)}" for _ in range(40)]
        for s in sentences:
            rows.append((n, " ".join(filler() + s + filler())))
            n += 1
        for _ in range(2):
            rows.append((n, " ".join(filler() + sum(sentences, []) + filler())))
            n += 1
    found = {r.doc_id: r for r in S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = [found.get(6 * p + 5) for p in range(30)]
    assert all(r and r.start_word == 40 and r.end_word == 100 for r in whole)
    assert all(r.src_doc_id == 6 * p + 4 for p, r in enumerate(whole))


def test_links_are_the_same_at_every_size(spark, monkeypatch):
    rng = random.Random(5)
    lines = [" ".join(f"l{i}w{j}" for j in range(30)) for i in range(6)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(lines) for _ in range(rng.randint(1, 4)))) for i in range(60)], "doc_id long, text string")
    plain = sorted(map(tuple, S._links(docs, S.K, S.W).collect()))
    monkeypatch.setattr(S, "HOT_SEED", 20)
    monkeypatch.setattr(S, "HOT_SAMPLE", 1.0)
    monkeypatch.setattr(S, "LEAST_SALTS", 4)
    assert plain and sorted(map(tuple, S._links(docs, S.K, S.W).collect())) == plain


def covered(rows, size):
    """Per row the words in windows of `size` words that an earlier document has too, by exact sets."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        words = (text or "").split()
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if seen.setdefault(window, doc_id) < doc_id:
                out.setdefault(doc_id, set()).update(range(i, i + size))
    return out


def recombined(rng, n):
    """Documents of fillers and of passages and sentences that others have, in any order."""
    fresh = lambda k: [f"f{rng.randrange(10**9)}" for _ in range(k)]
    shared = [fresh(rng.randint(12, 90)) for _ in range(n // 4)]
    return [(i, " ".join(sum((x for _ in range(rng.randint(1, 5)) for x in (fresh(rng.randint(0, 40)), rng.choice(shared))), []))) for i in range(n)]


@pytest.mark.parametrize("seed,hot", [(1, 50_000), (2, 50_000), (3, 1)])
def test_every_repeated_run_of_50_words_is_covered(spark, monkeypatch, seed, hot):
    rows = recombined(random.Random(seed), 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, S.repeated_passages(docs).collect()))
    monkeypatch.setattr(S, "HOT_SEED", hot)
    if hot == 1:
        monkeypatch.setattr(S, "HOT_SAMPLE", 1.0)
    found = sorted(map(tuple, S.repeated_passages(docs.repartition(7)).collect()))
    assert found == plain  # neither hot seeds nor parts change a row
    got = {}
    for r in found:
        got.setdefault(r[0], set()).update(range(r[1], r[2]))
    want, near = covered(rows, 50), covered(rows, 8)
    assert want and all(len(x & got.get(i, set())) >= 0.99 * len(x) for i, x in want.items())
    assert sum(len(x & near[i]) for i, x in got.items()) >= 0.95 * sum(map(len, got.values()))  # the rest are edits within passages


def test_stretches_that_only_touch_are_no_passage(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, f"x1 x2 x3 {one} x4 x5 x6"), (2, f"y1 y2 y3 {two} y4 y5 y6"), (3, f"z1 z2 {one} {two} z3 z4")]
    assert S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_texts_of_one_id_that_differ(spark):
    words = lambda x, n=80: " ".join(f"{x}{i}" for i in range(n))
    rows = [(1, words("a")), (2, words("b")), (2, words("c")), (3, words("b")), (4, words("c")), (5, words("a")), (5, words("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = S.repeated_passages(docs)
    by_doc = {r.doc_id for r in found.collect()}
    assert len(by_doc & {3, 4}) == 1 and by_doc <= {3, 4, 5}  # one of the texts stands for 2
    kept = [r.text for r in S.without_passages(docs, found).collect()]
    assert words("d") in kept and kept.count(words("b")) >= 1 and kept.count(words("c")) >= 1
