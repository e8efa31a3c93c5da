"""Pooling of given token vectors, for passages and queries, with a length limit."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from millrace.operators import providers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

VECTORS = np.random.default_rng(1).normal(size=(1000, 6))
START, END = 1, 2
calls = []


def encode(text):
    return [START, *[3 + sum(map(ord, w)) % 900 for w in text.split()], END]


def load():
    def run(ids, mask):
        calls.append(ids.shape)
        assert ((ids > 0) == (mask > 0)).all()
        return VECTORS[ids] + 5 * (mask == 0)[:, :, None]  # what padding gives mustn't count

    return encode, run


def expected(text, prefix, most):
    ids = encode(prefix + text)
    ids = ids if len(ids) <= most else [*ids[: most - 1], END]
    mean = VECTORS[ids].mean(axis=0)
    return mean / np.linalg.norm(mean)


@pytest.mark.parametrize("prefix", ["query: ", "passage: "])
def test_pooled_vectors_of_any_length(prefix, monkeypatch):
    monkeypatch.setattr(providers, "TOKENS_AT_ONCE", 1200)
    rng, calls[:] = np.random.default_rng(2), []
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 99, n)) for n in [3, 700, 1, 40, 509, 510, 511, 0, 5, 2000, 3]]
    got = providers.token_embedder(f"toy-{prefix}", load, prefix, end=END)(texts)
    assert np.allclose(got, [expected(t, prefix, 512) for t in texts])
    assert max(width for _, width in calls) == 512 and max(n * width for n, width in calls) <= 1200
    assert not np.allclose(got[0], expected(texts[0], "other: ", 512))


def test_limit_and_empty_batch():
    assert providers.token_embedder("toy-limit", load, "", 2)([]) == []
    ids = encode("a b c")[:2]
    assert np.allclose(providers.token_embedder("toy-cut", load, "", 2, unit=False)(["a b c"]), [VECTORS[ids].mean(axis=0)])
    with pytest.raises(ValueError):
        providers.token_embedder("toy-none", load, most_tokens=1, end=END)


def test_in_tasks(spark):
    def toy():
        table = np.arange(300, dtype=float).reshape(100, 3) + 1
        return lambda text: [ord(c) % 100 for c in text][:700], lambda ids, mask: table[ids]

    rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([1, 600, 30])], "k long, t string")
    got = providers.embed(rows, providers.token_embedder("toy-task", toy, ""), 3, "k", "t").collect()
    assert all(r.error is None and np.isclose(np.linalg.norm(r.embedding), 1) for r in got) and len({tuple(np.round(r.embedding, 9)) for r in got}) == 1
