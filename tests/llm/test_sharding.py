from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import sharding as S


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(1)
    counts = Counter(tuple(S.fisher_yates(3, rng).tolist()) for _ in range(6000))
    assert len(counts) == 6 and max(counts.values()) < 1200 and min(counts.values()) > 800
    assert S.fisher_yates(0, rng).tolist() == [] and S.fisher_yates(1, rng).tolist() == [0]


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17, 1000])
def test_shards_are_even_and_whole(spark, n):
    rows = [(i // 3, None if i % 7 == 0 else "" if i % 7 == 1 else f"text {i % 5}", "b", 1) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string, key int")
    found = S.shard(docs, 16, bucket_bytes=2000).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_the_seed_decides(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "doc_id long, text string").coalesce(1)
    place = lambda seed: {r.doc_id: (r.shard, r.slot) for r in S.shard(docs, 4, seed, 3000).collect()}
    assert place(1) == place(1) != place(2)


def test_one_hot_row_spreads(spark):
    docs = spark.createDataFrame([(1, "same text")] * 2000 + [(None, None)], "doc_id long, text string")
    counts = S.shuffled_buckets(docs, bucket_bytes=5000).groupBy("bucket").count().collect()
    assert len(counts) == 11 and max(r["count"] for r in counts) < 300


def test_two_levels_give_what_one_gives(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(600)], "doc_id long, text string").coalesce(2)
    plain = sorted(map(tuple, S.shuffled_buckets(docs, bucket_bytes=1200).collect()))
    monkeypatch.setattr(S, "MOST_BUCKETS", 3)
    assert len({r[0] for r in plain}) > 9 and sorted(map(tuple, S.shuffled_buckets(docs, bucket_bytes=1200).collect())) == plain


def test_very_long_texts_and_the_contract(spark, tmp_path):
    import zlib

    from millrace.llm import queries

    long = "wörd " * 200_000
    rows = [(1, long), (2, None), (3, ""), (None, "x"), (4, "naïve"), (4, "naïve")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op8_sharding(spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
