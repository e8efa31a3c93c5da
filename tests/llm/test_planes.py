import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import planes as P
from millrace.cluster import scratch
from millrace.llm.tokens import default_vocabulary, encoder, separable


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("ids", [[], [0], [1], [2**32 - 1, 0, 7], list(range(1000))])
def test_planes_round_trip(kind, ids):
    x = np.array(ids, dtype=np.uint32)
    assert P.join_planes(P.split_planes(x, kind), len(x), kind).tolist() == ids


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_files_round_trip(tmp_path, kind):
    rng = np.random.default_rng(1)
    docs = [(None if i == 3 else i * 5 - 7, rng.integers(0, 50_000, rng.integers(0, 400), dtype=np.uint32)) for i in range(50)]
    writer = P.Writer(f"file://{tmp_path}/x.planes", kind, block=256)
    for doc_id, ids in docs:
        writer.add([doc_id], np.array([len(ids)]), ids)
    writer.close()
    reader = P.Reader(f"{tmp_path}/x.planes")
    assert [(d, i.tolist()) for d, _, i in reader.documents()] == [(d, i.tolist()) for d, i in docs]
    whole = np.concatenate([i for _, i in docs])
    assert reader.chunk(3).tolist() == whole[768:1024].tolist()
    (tmp_path / "x.planes").write_bytes((tmp_path / "x.planes").read_bytes()[:-5])
    with pytest.raises(ValueError):
        P.Reader(f"{tmp_path}/x.planes")


def in_order(found):
    """Ids ascend, nulls first, and starts leave no gap."""
    found, start = sorted(found, key=lambda r: r.start), 0
    for r in found:
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


TEXTS = [None, "", " ", "Hello, World.", "ÉCOLE naïve e\u0301", "a.b,c don't I'LL", "<|endoftext|> x <|ENDOFTEXT|>", "İstanbul ΣΑΣ", "tab\tand\u00a0nbsp\r\nline", "1234 5,6 ... .,. हिन्दी", "word " * 30_000]


def test_cached_ids_are_the_library_s(spark):
    import pyarrow as pa

    e = encoder(default_vocabulary())
    assert separable(default_vocabulary())
    for _ in range(2):
        ids, at = e.encode(pa.array(TEXTS))
        for i, t in enumerate(TEXTS):
            assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_table_round_trip(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10**6), t) for t in TEXTS * 3] + [(None, "none"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, part int").repartition(3)
    found = P.token_planes(docs, kind="bit").collect()
    e = encoder(default_vocabulary())
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    in_order(found)
    assert P.read_planes(P.write_planes(docs.limit(0), scratch(spark, "none"))).count() == 0


def test_a_hot_id_is_dealt_to_several_files(spark, monkeypatch):
    monkeypatch.setattr(P, "FILE_BYTES", 300)
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(400)] + [(8, "same")] * 300 + [(None, "x")] * 50, "doc_id long, text string")
    index = P.write_planes(docs, scratch(spark, "hot"))
    assert index.count() > 8 and max(r.docs for r in index.collect()) < 300
    found = P.read_planes(index).collect()
    assert len(found) == 750
    in_order(found)


def test_a_vocabulary_with_capitals_keeps_them(tmp_path):
    import pyarrow as pa

    spec = json.loads(open(default_vocabulary()).read())
    spec["normalizer"]["normalizers"] = [x for x in spec["normalizer"]["normalizers"] if x["type"] != "Lowercase"]
    (tmp_path / "v.json").write_text(json.dumps(spec))
    e = encoder(str(tmp_path / "v.json"))
    texts = [t or "" for t in TEXTS[:8]] + ["Hello World"]
    ids, at = e.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
