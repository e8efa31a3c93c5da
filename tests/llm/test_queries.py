"""The subpackage's queries against DuckDB where SQL can say them, and the pipeline as a whole."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, of_spark, of_sql

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["op4_url_filters", "op10_quality_rules", "op11_hard_negatives", "op12_embedding_near_dedup"])
def test_query_matches_its_sql(spark, name):
    assert of_spark(entry.queries()[name](spark, FOLDER)) == of_sql(connect(FOLDER), entry.oracle_sql()[name])


def test_all_are_registered():
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in entry.queries()) == 1
    assert "pipeline" in entry.queries()


def test_pipeline_keeps_clean_rows_and_catches_planted_ones(spark, tmp_path):
    import random

    import corpus_pipeline as P

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage = text(30), text(60)
    rows = {i: text(80) for i in range(200)}
    toxic = set(range(0, 200, 4))
    for i in toxic:
        rows[i] += " you idiot and stupid scum"
    rows |= {300: text(50) + " an 1d10t and st*pid one", 301: rows[1], 302: rows[2] + " more", 303: f"{text(70)} {passage} {text(10)}", 304: f"{text(70)} {passage} {text(10)}", 305: f"{text(40)} {item} {text(40)}", 306: None, 307: ""}
    save = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    save([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int", "labels")
    save([(0, item)], "item_id long, text string", "benchmark")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, str(tmp_path)), name)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(200)) - toxic
    assert set(seen["toxicity"]) == clean | {301, 302, 303, 304, 305, 306, 307}
    assert set(seen["ngram_jaccard"]) == clean | {303, 304, 305, 306}
    assert set(seen["substring_dedup"]) == clean | {303, 304, 305, 306}
    assert passage in seen["substring_dedup"][303] and passage not in seen["substring_dedup"][304]
    assert set(seen["decontamination"]) == clean | {303, 304, 306}
    packed = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen["decontamination"])


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, own long, of string, spans int, at long, least string, mark int, leak string, doc int, key string, digest string, row int, host string, bands int"


@pytest.mark.parametrize("case", ["no documents", "no labels", "no benchmark", "clashing names", "only nulls"])
def test_pipeline_of_odd_tables(spark, tmp_path, case):
    import corpus_pipeline as P

    base = [(i, f"some words of text number {i} " + " ".join(f"w{i}x{j}" for j in range(70)), "en", "s", 7) for i in range(12)] + [(3, None, None, None, None), (None, "no id here", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if case == "clashing names":
        base, schema = [(*r, 1, "x", 2, 3, "y", 4, "z", 5, "k", "d", 6, "h", 8) for r in base], CLASHING
    if case == "only nulls":
        base = [(None,) * 5] * 3
    save = lambda data, kind, name: spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    save([] if case == "no documents" else base, schema, "documents")
    save([] if case == "no labels" else [(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int", "labels")
    save([] if case == "no benchmark" else [(0, "a question that nobody asks of any text here at all")], "item_id long, text string", "benchmark")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == names
    packed = P.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in packed} == kept
    if case == "no documents":
        assert not packed
    elif case == "only nulls":
        assert kept == {None}
    else:
        assert kept >= set(range(12)) or case != "no labels"
