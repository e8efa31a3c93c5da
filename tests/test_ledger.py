"""Providers are called once a request, and the answer that is judged is the one that is returned."""

import os
import random
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace.operators import providers, retrieval, serving
from millrace.operators.ledger import Ledger

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


@pytest.fixture
def told(tmp_path):
    """A log of calls that workers append to."""
    path = str(tmp_path / "calls")
    open(path, "w").close()
    return path


def logged(path):
    with open(path) as f:
        return f.read().split()


def note(path, word):
    fd = os.open(path, os.O_WRONLY | os.O_APPEND)
    os.write(fd, f"{word}\n".encode())
    os.close(fd)


@pytest.fixture(scope="module")
def index(spark):
    store = spark.createDataFrame([(i, str(i), [1.0, float(i), 0.0, 0.0]) for i in range(4)], "position long, chunk_id string, embedding array<float>")
    chunks = spark.createDataFrame([(str(i), f"d{i}", f"passage number {i} tells of forts") for i in range(4)], "chunk_id string, document_id string, chunk_text string")
    return store, chunks


def at_random(path):
    """A generator that answers differently each time."""

    def make():
        def call(prompt):
            note(path, "llm")
            return random.choice(["passage number 0 tells of forts", "passage number 1 tells of forts", "quantum chips run cold"]) + f" {random.getrandbits(60):b}"[:0]

        return call

    return lambda rows: providers.generate(rows, "query_id", "prompt", make=make)


def test_chat_judges_the_answer_it_returns(spark, index, told):
    asked = spark.createDataFrame([(i, f"where is fort {i}?", [1.0, 0.0, 0.0, 0.0]) for i in range(8)], "query_id long, query string, embedding array<float>")
    rows = serving.chat(asked, *index, at_random(told), 4)
    first, again = rows.collect(), rows.collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert len(logged(told)) == 8
    for r in first:
        assert r.verdict == ("flagged" if "quantum" in r.answer else "grounded")


def test_voice_calls_each_provider_once_an_upload(spark, index, told):
    def hear(audio):
        note(told, "stt")
        return {"text": random.choice(["where is the fort?", "what is the fort?"])}

    def embedder(texts):
        note(told, "embed")
        return providers.hash_embedder(4)(texts)

    def say(text):
        note(told, f"tts:{text.replace(' ', '_')}")
        return text.encode()

    stub = providers.AUDIO_STUBS["mp3"]
    uploads = spark.createDataFrame([(i, stub + bytes([i]), "a.mp3", "audio/mp3") for i in range(6)], "query_id long, audio binary, filename string, content_type string")
    done = serving.voice(uploads, lambda rows: providers.transcribe(rows, "query_id", "audio", call=hear), *index, lambda rows: providers.embed(rows, embedder, 4, "query_id", "prompt", batch_size=1), at_random(told), lambda rows: providers.synthesize(rows, "query_id", "prompt", call=say), 4)
    rows = done.collect()
    calls = logged(told)
    count = lambda name: sum(c.split(":")[0] == name for c in calls)
    grounded = [r for r in rows if r.verdict == "grounded"]
    assert (count("stt"), count("embed"), count("llm"), count("tts")) == (6, 6, 6, len(grounded))
    import base64

    assert all(base64.b64decode(r.speech).decode() == r.answer for r in grounded)


def test_retriever_embeds_once(spark, index, told):
    def embedder(texts):
        note(told, "embed")
        return providers.hash_embedder(4)(texts)

    retriever = retrieval.Retriever(*index, lambda rows: providers.embed(rows, embedder, 4, "query_id", "query", batch_size=1), retrieval.rerank, 2)
    asked = spark.createDataFrame([(i, f"where is fort {i}?") for i in range(5)], "query_id long, query string")
    assert retriever.retrieve(asked).rows.filter("size(evidence) = 2").count() == 5
    assert len(logged(told)) == 5


def test_equal_prompts_are_called_once_and_a_later_run_calls_only_new_ones(spark, tmp_path, told):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", every=2)

    def make():
        def call(prompt):
            note(told, "llm")
            if prompt == "bad" and len(logged(told)) < 5:
                raise providers.ProviderError("down")
            return f"{prompt} {time.time_ns()}"

        return call

    run = lambda prompts: {r.k: (r.text, r.error) for r in providers.generate(spark.createDataFrame(list(enumerate(prompts)), "k long, prompt string"), "k", "prompt", make=make, ledger=ledger).collect()}
    first = run(["a", "b", "a", "bad", " "])
    assert len(logged(told)) == 3 and first[0] == first[2] and 4 not in first
    assert first[3] == (None, "ProviderError: down")
    second = run(["b", "c", "bad", "a"])
    assert len(logged(told)) == 5  # c and bad
    assert second[0] == first[1] and second[3] == first[0] and second[2][0].startswith("bad ")
    assert not [p for p in os.listdir(tmp_path / "ledger" / os.listdir(tmp_path / "ledger")[0]) if p.startswith("run-")]


def test_an_attempt_after_a_killed_one_calls_only_the_rest(spark, tmp_path, told):
    """The worker dies in the middle, as a lost executor would; local masters don't try tasks again, so this is the journal of a run that is resumed, and of an attempt of the same run."""
    from millrace.operators import ledger as L

    root = f"file://{tmp_path}/ledger"

    def make(fatal):
        def call(prompts):
            for p in prompts:
                note(told, p)
            if fatal and len(logged(told)) >= 20:
                os._exit(1)
            return [({"text": p.upper()}, None) for p in prompts]

        return lambda: call

    rows = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "k long, prompt string")
    book = Ledger(spark, root, every=4, tasks=1)
    with pytest.raises(Exception):  # noqa: B017
        book.ask("x", rows, "k", "prompt", {"text": "string"}, make(True))
    died = logged(told)
    assert len(died) == 20  # five entries, of which the last was not written
    (run,) = [p for p in os.listdir(tmp_path / "ledger" / "x") if p.startswith("run-")]
    parts = os.listdir(tmp_path / "ledger" / "x" / run)
    known = set().union(*(L.journaled(f"{root}/x/{run}/{p}") for p in parts))
    assert len(known) == 16  # what a second attempt of this task would skip
    got = {r.k: r.text for r in Ledger(spark, root, every=4).ask("x", rows, "k", "prompt", {"text": "string"}, make(False)).collect()}
    assert got == {i: f"P{i}" for i in range(40)}
    assert len(logged(told)) == 20 + 24


def test_vectors_by_ledger(spark, tmp_path, told):
    def embedder(texts):
        note(told, len(texts))
        if "no" in texts:
            raise RuntimeError("refused")
        return providers.hash_embedder(4)(texts)

    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "no")], "k long, t string")
    book = Ledger(spark, f"file://{tmp_path}/ledger", tasks=1)
    run = lambda: {r.k: (r.embedding, r.error) for r in providers.embed(rows, embedder, 4, "k", "t", batch_size=1, ledger=book).collect()}
    got = run()
    assert got[0][0] == got[2][0] == providers.hash_embedder(4)(["a"])[0] and got[3] == (None, "RuntimeError: refused")
    assert len(logged(told)) == 3
    assert run()[1] == got[1] and len(logged(told)) == 4  # only the refused one again
    assert providers.embed(rows.limit(0), embedder, 4, "k", "t", ledger=Ledger(spark)).count() == 0


def test_stream_appends_of_several_calls(spark, tmp_path):
    from millrace.sources.vector_store import VectorStore
    from millrace.streaming import live

    source = f"{tmp_path}/in"
    vectors = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("chunk_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding")).coalesce(1)
    store = VectorStore(spark, f"file://{tmp_path}/store")
    store.save(vectors(0, 5), "chunk_id", dimension=2)
    read = lambda: spark.readStream.schema("chunk_id string, embedding array<double>").option("maxFilesPerTrigger", 1).parquet(source)
    vectors(5, 10).write.parquet(source)
    live.append_to_index(read(), store, "chunk_id")
    assert store.load(2).count() == 10
    live.append_to_index(read(), store, "chunk_id")
    assert store.load(2).count() == 10
    for a in (10, 12):
        vectors(a, a + 2).write.mode("append").parquet(source)
    live.append_to_index(read(), store, "chunk_id")
    rows = store.load(2)
    assert sorted(int(r.chunk_id) for r in rows.collect()) == list(range(14)) and rows.select("position").distinct().count() == 14
    (streams,) = store.manifest()["streams"].items()
    assert streams[1] == 2
    # a batch that ran but wasn't noted as done is appended once
    assert store.appended(streams[0], 2) and not store.appended(streams[0], 3) and not store.appended("other", 0)
