import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import packing as P


def check(windows, size, pieces):
    """Every id in one piece, windows within size, and all but a power of two full."""
    seen = defaultdict(dict)
    for w in windows:
        assert w.fill == sum(len(p.ids) for p in w.pieces) <= size
        assert w.fill == size or w.fill & (w.fill - 1) == 0
        for p in w.pieces:
            assert len(p.ids) and p.start not in seen[p.doc_id]
            seen[p.doc_id][p.start] = p.ids
    for p in pieces:
        assert np.concatenate([x for _, x in sorted(seen[p.doc_id].items())]).tolist() == p.ids.tolist()


@pytest.mark.parametrize("size,most,high", [(16, 1000, 20), (16, 4, 15), (64, 8, 300), (8, 2, 5)])
def test_packer_keeps_every_id(size, most, high):
    rng = random.Random(size + most)
    packer, pieces = P.Packer(size, most), []
    for i in range(400):
        ids = np.arange(rng.randint(1, high), dtype=np.uint32) + i
        pieces.append(P.Piece(i, 0, ids, len(ids)))
        packer.add(pieces[-1])
        assert packer.open <= most
        assert packer.counts.sum() == packer.open == sum(map(len, packer.levels.values()))
    packer.finish()
    check(packer.done, size, pieces)


def test_choice_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    for _ in range(200):
        packer = P.Packer(12)
        packer.counts[1:12] = rng.integers(0, 4, 11)
        n = int(rng.integers(1, 12))
        levels = [0, *[h for h in range(1, 12 - n + 1) if packer.counts[h]]]

        def total(h, n=n, packer=packer):
            c = packer.counts.copy()
            if h:
                c[h] -= 1
            c[h + n] += 1
            return int((c[1:12] ** 2).sum())

        assert total(packer._best(n)) == min(map(total, levels))


def test_pieces_of_a_table(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["hello", "world", "strange", "zzzqx"]) for _ in range(rng.randint(0, 400)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "no id"), (102, "twice"), (102, "twice"), (103, "long words " * 6000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, offset int, sequence_id string").coalesce(2)
    found = P.pack(docs, with_ids=True).collect()
    windows, whole = defaultdict(list), defaultdict(list)
    for r in found:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        windows[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert whole[100] == whole[101] == [(0, 1, 1)]
    assert len(whole[102]) == 2 and len(whole[None]) >= 1
    for doc_id, parts in whole.items():
        if doc_id != 102:
            assert sum(n for _, n, _ in parts) == parts[0][2]
    assert P.pack(docs.limit(0)).count() == 0
