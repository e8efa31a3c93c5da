import random
import re
from collections import Counter, defaultdict

import duckdb

from compare import of_spark, of_sql
from millrace.llm import quality as Q

SCHEMA = "doc_id long, text string, source string, row int, key string, lines int"


def brute(rows, least=5, share=0.05, left=0.3):
    key = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    chars = lambda x: len(re.sub(r"[\x20\x09-\x0D]", "", x))
    documents, seen = defaultdict(set), defaultdict(set)
    held = lambda t: [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    for row, (doc_id, t, s) in enumerate(rows):
        document = ("id", doc_id) if doc_id is not None else ("row", row)
        documents[s].add(document)
        for x in held(t):
            seen[s, key(x)].add(document)
    out = []
    for doc_id, t, s in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines, total = held(t), sum(map(len, words))
        gone = sum(chars(x) for x in lines if len(seen[s, key(x)]) > max(least, share * len(documents[s])))
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        out.append((doc_id, len(words), total, sum(map((t or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered), gone, failed, not failed and not total - gone < left * total))
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcé#|") for _ in range(rng.randint(1, 5)))
    common = [" ".join(word() for _ in range(8)) for _ in range(4)]
    rows = []
    for i in range(150):
        lines = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 8))]
        lines += rng.sample(common, rng.randint(0, 3)) if i % 2 else []
        if i % 5 == 0:
            lines += lines[:2] * 3
        rng.shuffle(lines)
        rows.append((i, "\n".join(x if rng.random() < 0.8 else f"  {x.upper()}\t" for x in lines), rng.choice(["a", "a", "b", None, ""])))
    rows += [(200, None, "a"), (201, "", "a"), (202, " \n\t\r", "b"), (None, "x " * 30, "a"), (5, rows[5][1], rows[5][2]), (203, "w " * 20_000, "c"), (204, "a\u00a0b " * 25, "c")]
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    found = [tuple(r) for r in Q.judge(docs).collect()]
    order = lambda r: (r[0] is None, r)
    assert sorted(found, key=order) == sorted(brute(rows), key=order)
    assert any(r[6] for r in found)
    assert Q.judge(docs.limit(0)).count() == 0


def test_depleted_documents_are_rejected(spark):
    boiler = "the same long line of boilerplate words that every page of this host repeats again and again"
    own = "\n".join(f"own words {i} of a clean text" for i in range(12))
    rows = [(i, f"{boiler}\nnumber {i} only", "h") for i in range(20)] + [(30, f"{boiler}\n{own}", "h")]
    found = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(r.removed_chars for r in found.values()) and not any(r.base_failed for r in found.values())
    assert [i for i, r in found.items() if r.kept] == [30]
    copies = [(i, own, "k") for i in range(50)]
    assert not any(r.kept for r in Q.judge(spark.createDataFrame(copies, "doc_id long, text string, source string")).collect())


def test_a_repeated_id_is_one_document_and_a_null_source_a_host_of_its_own(spark):
    own = "\n".join(f"own words {i} of a clean text" for i in range(12))
    rows = [(7, own, "k")] * 50 + [(i, own, None) for i in range(3)] + [(10 + i, own, "") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r.kept and not r.removed_chars for r in Q.judge(docs).collect())
    more = spark.createDataFrame([(None, own, None) for i in range(3)], docs.schema)
    found = Q.judge(docs.unionAll(more)).collect()
    assert {(r.doc_id, r.kept) for r in found if r.doc_id != 7} == {(0, False), (1, False), (2, False), (None, False), (10, True), (11, True), (12, True)}


def test_the_sql_gives_the_same_on_nulls_and_repeats(spark, tmp_path):
    own = "\n".join(f"own words {i} of a clean text" for i in range(12))
    rows = [(7, own, "k")] * 9 + [(i, own, None) for i in range(4)] + [(10 + i, own, "") for i in range(7)] + [(None, own, None)] * 4 + [(30, None, ""), (31, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert of_spark(Q.judge(docs)) == of_sql(con, Q.ORACLE)
