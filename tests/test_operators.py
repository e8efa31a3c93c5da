import pytest
from pyspark.sql import functions as F

from millrace.operators import analytics, chunking, dedup, grounding, ingest, profiling, providers, retrieval, validate

PASSAGE = "document_id string, query_id long, passage_index int, query string, query_type string, answer string, source_lang string, target_lang string, eng_query string, eng_answer string, translated_passage string, english_passage string, is_selected boolean"
RAW = "query_id string, Query string, Eng_Query string, source_lang string, target_lang string, passages struct<Translated_passages: array<string>, English_passages: array<string>, is_selected: array<string>>"


def record(qid="1", query="q", eng="e", lang="hi", a=("x", "y", "z"), b=("X", "Y", "Z"), f=("1", "0", "0")):
    return (qid, query, eng, "en", lang, (None if a is None else list(a), list(b), list(f)))


def flat(spark, *records):
    return ingest.flatten(spark.createDataFrame(list(records), RAW)).orderBy("query_id", "passage_index").collect()


def test_flatten_aligns_to_the_shortest_array(spark):
    rows = flat(spark, record())
    assert [(r.passage_index, r.translated_passage, r.english_passage, r.is_selected) for r in rows] == [(0, "x", "X", True), (1, "y", "Y", False), (2, "z", "Z", False)]
    assert len(flat(spark, record(b=("X", "Y")))) == 2
    assert len(flat(spark, record(b=()))) == len(flat(spark, record(a=None))) == 0
    assert [r.passage_index for r in flat(spark, record(a=("x", "  ", "z")))] == [0, 2]
    assert [r.is_selected for r in flat(spark, record(f=("2", "maybe", None)))] == [False] * 3


def test_bad_records_are_rejected_with_a_reason(spark):
    raw = spark.createDataFrame([record(), record("abc"), record(None), record("4", " ", ""), record("5", "", "e")], RAW)
    assert sorted(str(r.reject) for r in ingest.canonical_records(raw).collect()) == ["None", "None", "bad_query_id", "bad_query_id", "blank_queries"]
    assert flat(spark, record("5", "", "e")) == []


def test_known_id(spark):
    assert flat(spark, record())[0].document_id == "8f43e5e94dcb44911844586b9c50a8666565e6e7d6937ab6265ea49c3b17a3a7"


def passages(spark, *rows):
    """rows of (ord, document_id, language, text, flag)."""
    return spark.createDataFrame(list(rows), "ord long, document_id string, target_lang string, translated_passage string, is_selected boolean").withColumn("english_passage", F.col("translated_passage"))


@pytest.mark.parametrize("flags,kept,number", [("FT", 1, 1), ("TT", 0, 0), ("FFTTF", 2, 2), ("FF", 0, 0), ("TF", 0, 1)])
def test_content_dedup_prefers_selected_rows(spark, flags, kept, number):
    rows = passages(spark, *[(i, f"d{i}", "hi", "same", f == "T") for i, f in enumerate(flags)], (50, "e", "bn", "same", False))
    out = {r.ord: r.place for r in dedup.by_content(rows).collect()}
    assert out == {kept: 0, 50: 50}
    assert [r.conflicts for r in dedup.conflicts(rows).collect()] == [number]
    assert {r.ord for r in dedup.incremental(rows).collect()} == {0, 50}
    assert dedup.by_content(dedup.by_content(rows).drop("place")).count() == 2


def test_identity_dedup_keeps_the_first(spark):
    rows = passages(spark, (3, "a", "hi", "x", True), (1, "a", "hi", "y", False), (2, "b", "hi", "z", False))
    assert {(r.ord, r.document_id) for r in dedup.by_identity(rows).collect()} == {(1, "a"), (2, "b")}


def test_validation_counts_every_error(spark):
    good = "8f43e5e94dcb44911844586b9c50a8666565e6e7d6937ab6265ea49c3b17a3a7"
    rows = spark.createDataFrame(
        [
            (good, 1, 0, "q", None, None, "en", "hi", "e", None, "t", "p", True),
            ("", 1, 0, " ", None, " ", "en", "hi", "e", None, "t", "p", True),
            ("other", None, -1, "q\x01", " ", None, "", "hi", "e", None, None, "p", None),
        ],
        PASSAGE,
    )
    found = {r.error_type: r.n for r in validate.error_counts(rows).collect()}
    assert found == {k: 1 for k in ("empty_document_id", "empty_query", "whitespace_answer", "invalid_query_id_type", "negative_passage_index", "invalid_control_chars", "whitespace_query_type", "empty_source_lang", "empty_translated_passage", "invalid_is_selected_type", "empty_document_id")} | {"inconsistent_document_id": 1}
    assert [r.is_valid for r in validate.with_errors(rows).orderBy("is_valid").collect()] == [False, False, True]


def chunks(spark, make, text, *args):
    rows = make(spark.createDataFrame([("d", text)], "document_id string, text string"), *args).orderBy("chunk_index").collect()
    assert len({r.chunk_id for r in rows}) == len(rows)
    return [r.chunk_text for r in rows]


def test_sentence_chunks(spark):
    assert chunks(spark, chunking.sentence_chunks, "S1. S2. S3. S4.", 2, 0) == ["S1. S2.", "S3. S4."]
    assert chunks(spark, chunking.sentence_chunks, "S1. S2. S3. S4.", 2, 1) == ["S1. S2.", "S2. S3.", "S3. S4.", "S4."]
    assert chunks(spark, chunking.sentence_chunks, "A. B. C. D. E.") == ["A. B. C.", "C. D. E.", "E."]
    assert chunks(spark, chunking.sentence_chunks, "First. Second. Third.") == ["First. Second. Third."]


def test_token_chunks(spark):
    words = " ".join(map(str, range(10)))
    assert chunks(spark, chunking.token_chunks, words, 4, 1) == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]
    assert chunks(spark, chunking.token_chunks, "a b") == ["a b"] and chunks(spark, chunking.token_chunks, "  ") == []


@pytest.mark.parametrize("text,rule", [("x" * 500, "passage"), ("x" * 501, "token"), ("ab. " * 200, "sentence"), ("ab " * 200, "token"), ("a b. " * 600, "token"), ("w " * 240 + "." + "v " * 200, "passage")])
def test_adaptive_rule(spark, text, rule):
    assert spark.createDataFrame([(text,)], "x string").select(chunking.adaptive_rule(F.col("x")).alias("r")).first().r == rule


def test_engine_and_arguments(spark):
    engine = chunking.ChunkingEngine()
    engine.register("whole", chunking.passage_chunks)
    rows = spark.createDataFrame([("d", "t")], "document_id string, text string")
    assert engine.chunk(rows, "whole").count() == 1
    with pytest.raises(ValueError):
        engine.chunk(rows, "none")
    for size, overlap in ((0, 0), (3, 3), (3, -1)):
        with pytest.raises(ValueError):
            chunking.sentence_chunks(rows, size, overlap)


def test_top_k(spark):
    store = spark.createDataFrame([(i, [float(i % 4), 1.0]) for i in range(20)], "position long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [-1.0, 0.0])], "query_id long, embedding array<float>")
    found = {(r.query_id, r["rank"]): r.position for r in retrieval.batched_top_k(store, queries, 3).collect()}
    assert found == {(7, 0): 3, (7, 1): 7, (7, 2): 11, (8, 0): 0, (8, 1): 4, (8, 2): 8}
    assert [r.position for r in retrieval.top_k(store, [1.0, 0.0], 3).collect()] == [3, 7, 11]
    assert retrieval.batched_top_k(store, queries.limit(0), 3).count() == 0
    assert retrieval.batched_top_k(store, queries, 50).count() == 40
    for bad in (0, -1, 1.5, True, "3"):
        with pytest.raises(ValueError):
            retrieval.top_k(store, [1.0, 0.0], bad)


def test_rerank_prefers_overlap(spark):
    rows = spark.createDataFrame([(1, "goa beach", 0, 0.75, "something else"), (1, "goa beach", 1, 0.70, "the beach of goa")], "query_id long, query string, rank int, score double, text string")
    assert [r["rank"] for r in retrieval.rerank(rows, 2, 0.5, 0.5).orderBy("new_rank").collect()] == [1, 0]


def test_grounding(spark):
    answers = spark.createDataFrame([(1, "Goa has many beaches."), (2, "Goa has 99 beaches."), (3, "Quantum chips run cold."), (4, "Goa has many beaches.")], "answer_id long, answer string")
    evidence = spark.createDataFrame([(i, "Goa has many beaches.") for i in (1, 2, 3)], "answer_id long, text string")
    found = {r.answer_id: (r.verdict, round(r.score, 4)) for r in grounding.roll_up(grounding.claim_scores(answers, evidence)).collect()}
    assert found[1] == ("grounded", 1.0) and found[2] == ("flagged", 0.0) and found[3][0] == "flagged" and found[4] == ("flagged", 0.0)


def test_latency(spark):
    rows = spark.createDataFrame([("s", float(10 * i)) for i in range(1, 11)], "stage string, ms double")
    assert tuple(analytics.percentiles(rows, [0.5, 0.7, 1.0], ["a", "b", "c"]).first())[1:] == (55.0, 73.0, 100.0)
    assert tuple(analytics.index_percentiles(rows).first())[1:] == (60.0, 100.0, 100.0)
    assert analytics.latest(rows, "ms", last=3).count() == 3


def test_breaker(spark):
    rows = spark.createDataFrame([("k", i, c == "1") for i, c in enumerate("1000100")], "key string, seq long, ok boolean")
    assert [(r.in_a_row, r.state) for r in analytics.breaker_states(rows).orderBy("seq").collect()] == [(0, "closed"), (1, "closed"), (2, "closed"), (3, "open"), (0, "closed"), (1, "closed"), (2, "closed")]
    now = [0.0]
    breaker = providers.CircuitBreaker(lambda: now[0])
    for _ in range(3):
        breaker.record(False)
    assert breaker.state == "open"
    now[0] = 31
    assert breaker.state == "half_open"
    breaker.record(True)
    assert breaker.state == "closed"


def test_resilience():
    calls, pauses = [], []

    def call(prompt):
        calls.append(prompt)
        raise TimeoutError if prompt == "slow" else KeyError

    run = providers.with_resilience(call, (TimeoutError,), "sorry", sleep=pauses.append)
    assert run("slow") == ("sorry", 3, True) and pauses == [0.5, 1.0]
    assert run("odd") == ("sorry", 1, True)


def test_embedding_errors_are_told(spark):
    rows = spark.createDataFrame([(f"c{i}", "bad" if i == 5 else "good") for i in range(8)], "chunk_id string, chunk_text string").coalesce(1)
    made = providers.hash_embedder(4)

    def embedder(texts):
        return [[float("nan")] * 4 if t == "bad" else v for t, v in zip(texts, made(texts))]

    found = providers.embed(rows, embedder, 4, batch_size=4).collect()
    assert [r.chunk_id for r in found if r.error] == ["c4", "c5", "c6", "c7"]
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in found if not r.error)


def test_profiles(spark):
    rows = spark.createDataFrame([(1, "hello", ["a"]), (2, "", []), (1, "goodbye", None)], "id long, q string, p array<string>")
    assert {r.field: r.missing for r in profiling.missing_counts(rows, "q", "p", "id").collect()} == {"q": 1, "p": 2, "id": 0}
    assert tuple(profiling.length_profile(rows, "q").first())[:5] == (3, 4.0, 5.0, 0, 7)
    assert [tuple(r) for r in profiling.duplicate_ids(rows, "id").collect()] == [(1, 2)]
    assert tuple(profiling.split_health(rows, "q", "p", "id").first()) == (3, 1, 2)
