import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm.words import shingles, slices, windows, words_of

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text or "")
    return WORD.findall(re.sub("[  -‿]", " ", low))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    letters = "abcXYZéÉßñ 0123.,-\n\t'“” हि"
    return [None, "", " ", "one", "One TWO", "ÉCOLE école", *["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(200)], "x" * 9000]


def test_words_are_those_of_a_plain_reading(texts):
    w = words_of(pa.array(texts))
    own = [[bytes(w.data[b:e]).decode().lower() for b, e in zip(w.begin[i:j], w.end[i:j])] for i, j in zip(w.first, w.first[1:])]
    assert [[x.lower() for x in plain(t)] for t in texts] == own
    by_word = {}
    for words, i in zip(own, w.first):
        for k, x in enumerate(words):
            assert by_word.setdefault(x, w.hashes[i + k]) == w.hashes[i + k]
    assert len(set(by_word.values())) == len(by_word)


def test_shingles_depend_on_the_text_alone(texts):
    whole, bounds = shingles(words_of(pa.array(texts)), 5)
    for i, t in enumerate(texts):
        alone, _ = shingles(words_of(pa.array([t], type=pa.string())), 5)
        assert whole[bounds[i] : bounds[i + 1]].tolist() == alone.tolist()
        n = len(plain(t))
        assert len(alone) == (max(n - 4, 1) if n else 0)


def test_windows_tell_order_apart():
    a = np.arange(10, dtype=np.uint64)
    assert len(set(windows(a, 3).tolist()) | set(windows(a[::-1].copy(), 3).tolist())) == 16
    assert len(windows(a, 11)) == 0


def test_slices_cover_a_batch(texts):
    batch = pa.RecordBatch.from_pydict({"text": texts, "n": list(range(len(texts)))})
    parts = list(slices(batch, "text", 100))
    assert [x for p in parts for x in p.column("n").to_pylist()] == list(range(len(texts)))
    assert len(parts) > 3
    assert list(slices(batch.slice(0, 0), "text")) == []
