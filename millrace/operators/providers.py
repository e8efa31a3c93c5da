"""Pluggable providers (embedding, generation, speech) over Arrow batches, with deterministic offline ones."""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import math
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import params
from .ledger import Caller, Ledger

# Words and lengths of the offline generator, audio stubs, transcription.
ANSWER_WORDS = "goa beach temple tourism fort church market answer grounded retrieval evidence citation गोवा समुद्र मंदिर पर्यटन किला बाजार उत्तर साक्ष्य".split()
LEAST_WORDS, MOST_WORDS = 4, 10
AUDIO_STUBS = {
    "mp3": b"ID3\x04\x00\x00\x00\x00\x00\x00\xff\xfb\x90\x00fake-mp3-audio-bytes",
    "wav": b"RIFF\x28\x00\x00\x00WAVEfmt \x10\x00\x00\x00\x01\x00\x01\x00\x44\xac\x00\x00\x88\x58\x01\x00\x02\x00\x10\x00data\x04\x00\x00\x00\x00\x00\x00\x00",
    "opus": b"OggS\x00\x02\x00\x00\x00\x00\x00\x00\x00\x00fake-opus-bytes",
    "flac": b"fLaC\x00\x00\x00\x22fake-flac-audio-bytes",
    "aac": b"\xff\xf1\x50\x80\x00\x1f\xfcfake-aac-bytes",
    "pcm": b"\x00\x00\x01\x00\x02\x00fake-raw-pcm-bytes",
}
TRANSCRIPTION = "This is a fake transcription of the provided audio."

Embedder = Callable[[list[str]], list[list[float]]]


def _seeded(text: str) -> random.Random:
    return random.Random(int.from_bytes(hashlib.sha256(text.encode()).digest()[:16], "big"))


def hash_embedder(dimension: int = 64) -> Embedder:
    """Unit vectors from a generator seeded by the text."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            rng = _seeded(text)
            raw = [rng.uniform(-1.0, 1.0) for _ in range(dimension)]
            n = math.sqrt(sum(x * x for x in raw))
            out.append([x / n for x in raw] if n else [1.0, *[0.0] * (dimension - 1)])
        return out

    return embed


def masked_mean(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of token vectors (text, token, dimension) where the mask (text, token) is set; a text without a token gives zeros."""
    weight = mask[:, :, None].astype(hidden.dtype)
    return (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


_models: dict[str, Any] = {}


def model_embedder(name: str, load: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]], prefix: str = "passage: ", unit: bool = True) -> Embedder:
    """Embedder of a model that is loaded at first use in each worker and kept there under its name.

    load gives a function from texts to (token vectors, mask); they are pooled by the masked mean and made unit
    vectors. prefix: models of the E5 family want `passage: ` before passages and `query: ` before queries.
    """

    def embed(texts: list[str]) -> list[list[float]]:
        if name not in _models:
            _models[name] = load()
        pooled = masked_mean(*_models[name]([prefix + x for x in texts]))
        if unit:
            pooled = pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)
        return pooled.tolist()

    return embed


#: Token limit of E5 models, and tokens that go through a model at once.
MOST_TOKENS, TOKENS_AT_ONCE = 512, 16_384


def token_embedder(name: str, load: Callable[[], tuple[Callable[[str], list[int]], Callable[[np.ndarray, np.ndarray], np.ndarray]]], prefix: str = "passage: ", most_tokens: int = MOST_TOKENS, end: int | None = None, unit: bool = True) -> Embedder:
    """As model_embedder, of a tokenizer and a model: load gives (text to ids, special ones included; ids and mask to token vectors).

    Texts of more than most_tokens ids are cut there, and end, the id that ends a text, takes the last place. Texts of like length go
    through the model together, at most TOKENS_AT_ONCE tokens with their padding, which the mask leaves out.
    """
    if most_tokens < 1 + (end is not None):
        raise ValueError("a text needs room for a token")

    def embed(texts: list[str]) -> list[list[float]]:
        if name not in _models:
            _models[name] = load()
        encode, run = _models[name]
        ids = [encode(prefix + x) for x in texts]
        ids = [x if len(x) <= most_tokens else x[:most_tokens] if end is None else [*x[: most_tokens - 1], end] for x in ids]
        order, out, at = sorted(range(len(ids)), key=lambda i: len(ids[i])), [None] * len(ids), 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and len(ids[order[stop]]) * (stop + 1 - at) <= TOKENS_AT_ONCE:
                stop += 1
            part, width = order[at:stop], max(1, len(ids[order[stop - 1]]))
            whole, mask = np.zeros((len(part), width), dtype=np.int64), np.zeros((len(part), width), dtype=np.int64)
            for row, i in enumerate(part):
                whole[row, : len(ids[i])], mask[row, : len(ids[i])] = ids[i], 1
            pooled = masked_mean(run(whole, mask), mask)
            if unit:
                pooled = pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)
            for row, i in enumerate(part):
                out[i] = pooled[row].tolist()
            at = stop
        return out

    return embed


def embed(rows: DataFrame, embedder: Embedder, dimension: int, key: str = "chunk_id", text: str = "chunk_text", batch_size: int = 32, fail_fast: bool = False, on_error: Callable[[dict], None] | None = None, ledger: Ledger | None = None) -> DataFrame:
    """(key, embedding, error, batch) in micro-batches of batch_size rows, whatever Arrow batches they come in.

    A batch that fails, or gives a wrong number, length or a value that isn't a finite number, is an error:
    raised, or told in every row of the batch. batch: its number, unique in the run. on_error gets
    {batch, keys, error} on the worker; what it raises is ignored. With a ledger each distinct text is
    embedded once, and `keys` are its requests.
    """
    ship(rows.sparkSession)
    if batch_size <= 0 or dimension <= 0:
        raise ValueError("batch size and dimension have to be positive")

    def number(x: object) -> bool:
        return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)

    def vectors_of(texts: list, keys: list, batch: int) -> tuple[list, str | None]:
        try:
            if any(not isinstance(x, str) or not x.strip() for x in texts):
                raise ValueError("blank text")
            vectors = embedder(texts)
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            if any(len(v) != dimension or not all(map(number, v)) for v in vectors):
                raise ValueError("a vector has a wrong length or a value that isn't a finite number")
            return vectors, None
        except Exception as e:
            if fail_fast:
                raise
            error = f"{type(e).__name__}: {e}"
            if on_error is not None:
                try:
                    on_error({"batch": batch, "keys": keys, "error": error})
                except Exception:  # noqa: S110 - the callback's own failure doesn't count
                    pass
            return [None] * len(texts), error

    if ledger is not None:

        def make() -> Caller:
            numbers = itertools.count(TaskContext.get().partitionId() << 33)

            def call(texts: list) -> list[tuple[dict | None, str | None]]:
                batch = next(numbers)
                vectors, error = vectors_of(texts, [hashlib.sha256(x.encode()).hexdigest() for x in texts], batch)
                return [({"embedding": v, "batch": batch}, error) for v in vectors]

            return call

        return ledger.ask(f"embed-{dimension}", rows, key, text, {"embedding": "array<double>", "batch": "long"}, make, batch_size).select(key, "embedding", "error", "batch")

    def one(part: pd.DataFrame, batch: int) -> pd.DataFrame:
        vectors, error = vectors_of(part[text].tolist(), part[key].tolist(), batch)
        return pd.DataFrame({key: part[key].tolist(), "embedding": vectors, "error": [error] * len(part), "batch": [batch] * len(part)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, waiting = TaskContext.get().partitionId() << 33, None
        for frame in frames:
            waiting = frame if waiting is None else pd.concat([waiting, frame], ignore_index=True)
            while len(waiting) >= batch_size:
                yield one(waiting.iloc[:batch_size], batch)
                waiting, batch = waiting.iloc[batch_size:], batch + 1
        if waiting is not None and len(waiting):
            yield one(waiting, batch)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>, error string, batch long")


def failures(embedded: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(batch, keys, error) of the batches of embed() that failed."""
    return embedded.filter("error IS NOT NULL").groupBy("batch").agg(F.sort_array(F.collect_list(key)).alias("keys"), F.first("error").alias("error"))


def _called(rows: DataFrame, key: str, given: str, columns: dict[str, str], make: Callable[[], Callable[[Any], dict]], ledger: Ledger | None = None, stage: str = "calls") -> DataFrame:
    """(key, columns, error): call one row at a time; make builds the call in the task. What a call raises is told in its row.

    With a ledger each distinct request is called once, now, and kept; without one, whenever the result is read.
    """
    ship(rows.sparkSession)
    names = list(columns)
    if ledger is not None:

        def caller() -> Caller:
            call = make()

            def one(x: Any) -> tuple[dict | None, str | None]:
                try:
                    return call(x), None
                except Exception as e:
                    return None, f"{type(e).__name__}: {e}"

            return lambda requests: [one(x) for x in requests]

        return ledger.ask(stage, rows, key, given, columns, caller)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for frame in frames:
            out, errors = [], []
            for x in frame[given]:
                try:
                    out.append(call(x))
                    errors.append(None)
                except Exception as e:
                    out.append({})
                    errors.append(f"{type(e).__name__}: {e}")
            made = {n: pd.Series([r.get(n) for r in out], dtype=object) for n in names}
            yield pd.DataFrame({key: frame[key].to_numpy(), **made, "error": pd.Series(errors, dtype=object)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, given).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} {t}" for n, t in columns.items()) + ", error string")


LLM_COLUMNS = {"text": "string", "prompt_tokens": "long", "completion_tokens": "long", "total_tokens": "long"}


def usage(prompt: str, text: str) -> dict:
    """An answer with its numbers of white space words."""
    asked, made = len(prompt.split()), len(text.split())
    return {"text": text, "prompt_tokens": asked, "completion_tokens": made, "total_tokens": asked + made}


def offline_answer(prompt: str, most_words: int = 256) -> str:
    """The offline generator's words for a prompt."""
    rng = _seeded(prompt)
    n = max(1, min(rng.randint(LEAST_WORDS, MOST_WORDS), most_words))
    return " ".join(rng.choice(ANSWER_WORDS) for _ in range(n))


def generate(rows: DataFrame, key: str, prompt: str, most_words: int = 256, make: Callable[[], Callable[[str], str]] | None = None, temperature: float = 0.7, top_p: float = 1.0, ledger: Ledger | None = None) -> DataFrame:
    """(key, text, prompt_tokens, completion_tokens, total_tokens, error) of prompts that aren't blank, by the offline generator or by what make gives in each task (an adapter, a Harness)."""
    params.max_tokens(most_words)
    params.temperature(temperature)
    params.top_p(top_p)

    def start() -> Callable[[str], dict]:
        call = make() if make else lambda x: offline_answer(x, most_words)
        return lambda x: usage(x, params.text(call(x), 1 << 30, "answer"))

    return _called(rows.filter(f"trim({prompt}) <> ''"), key, prompt, LLM_COLUMNS, start, ledger, f"generate-{most_words}-{temperature}-{top_p}")


def with_resilience(call: Callable[[str], str], provider_errors: tuple[type[Exception], ...], fallback: str, retries: int = 2, base: float = 0.5, most: float = 8.0, sleep: Callable[[float], None] | None = None) -> Callable[[str], tuple[str, int, bool]]:
    """call with retries: (answer, tries, failed). Provider errors are tried again after a growing pause; any other error isn't. A failure gives the fallback."""

    def run(prompt: str) -> tuple[str, int, bool]:
        for attempt in range(retries + 1):
            try:
                return call(prompt), attempt + 1, False
            except provider_errors:
                if attempt < retries and sleep:
                    sleep(min(most, base * 2**attempt))
            except Exception:
                return fallback, attempt + 1, True
        return fallback, retries + 1, True

    return run


class CircuitBreaker:
    """Closed until `failures` failures in a row; open for `recovery` seconds; then half open until the next outcome."""

    def __init__(self, clock: Callable[[], float], failures: int = 3, recovery: float = 30.0):
        if failures < 1 or recovery <= 0:
            raise ValueError("a breaker needs failures >= 1 and recovery > 0")
        self.clock, self.failures, self.recovery = clock, failures, recovery
        self.count, self.tripped, self.at = 0, False, 0.0

    @property
    def state(self) -> str:
        return "closed" if not self.tripped else "half_open" if self.clock() - self.at >= self.recovery else "open"

    def record(self, ok: bool) -> None:
        if ok:
            self.count, self.tripped = 0, False
        else:
            self.count, self.at = self.count + 1, self.clock()
            self.tripped |= self.count >= self.failures


class ProviderError(Exception):
    """A provider that fails in a way that may pass."""


FALLBACK = "The service can't answer at the moment. Please try again later."


@dataclass
class Harness:
    """call behind retries, a circuit breaker and a fallback answer.

    While the breaker is open the fallback is given at once. Provider errors are tried again after a growing
    pause; any other error isn't. A prompt whose tries are used up counts as one failure of the breaker.
    """

    call: Callable[[str], str]
    breaker: CircuitBreaker
    provider_errors: tuple[type[Exception], ...] = (ProviderError,)
    fallback: str = FALLBACK
    retries: int = 3
    base: float = 0.2
    most: float = 2.0
    sleep: Callable[[float], None] = time.sleep
    tries: int = field(default=0, init=False)

    def __post_init__(self) -> None:
        if self.retries < 0 or self.base < 0:
            raise ValueError("retries and pauses can't be negative")

    def __call__(self, prompt: str) -> str:
        if self.breaker.state == "open":
            return self.fallback
        for attempt in range(self.retries + 1):
            self.tries += 1
            try:
                answer = self.call(prompt)
                self.breaker.record(True)
                return answer
            except self.provider_errors:
                if attempt < self.retries:
                    self.sleep(min(self.most, self.base * 2**attempt))
            except Exception:
                break
        self.breaker.record(False)
        return self.fallback


def _post(url: str, body: bytes, kind: str, headers: dict[str, str], timeout: float, secret: str | None) -> bytes:
    request = urllib.request.Request(url, body, {"Content-Type": kind, **headers})  # noqa: S310
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return answer.read()
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        told = str(e)
        raise ProviderError(told.replace(secret, "[REDACTED]") if secret else told) from None


@dataclass(frozen=True)
class HttpProvider:
    """A provider behind HTTP: where it is and how a key is sent. Objects of it go to the workers, and no connection is made before a call."""

    base_url: str
    model: str
    key: str | None = field(default=None, repr=False)
    key_header: str = "Authorization"
    key_format: str = "Bearer {}"
    timeout: float = 60.0

    def headers(self) -> dict[str, str]:
        return {self.key_header: self.key_format.format(self.key)} if self.key else {}

    def post_json(self, path: str, body: dict) -> Any:
        return json.loads(self.post(path, json.dumps(body).encode(), "application/json"))

    def post(self, path: str, body: bytes, kind: str) -> bytes:
        return _post(self.base_url.rstrip("/") + path, body, kind, self.headers(), self.timeout, self.key)

    def chat(self, system: str | None = None, temperature: float = 0.7, top_p: float = 1.0, max_tokens: int = 256) -> Callable[[str], str]:
        """Answers by a chat completion endpoint."""
        settings = {"model": self.model, "temperature": params.temperature(temperature), "top_p": params.top_p(top_p), "max_tokens": params.max_tokens(max_tokens)}

        def call(prompt: str) -> str:
            messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": params.text(prompt, 1 << 30, "prompt")}]
            found = self.post_json("/chat/completions", settings | {"messages": messages})
            try:
                return found["choices"][0]["message"]["content"]
            except (KeyError, IndexError, TypeError):
                raise ProviderError("the answer has no text") from None

        return call

    def transcribe(self, path: str = "/audio/transcriptions", language: str | None = None) -> Callable[[bytes], dict]:
        """Speech to text by an upload form."""
        code = params.language(language)

        def call(audio: bytes) -> dict:
            mark = hashlib.sha256(bytes(audio)).hexdigest()
            fields = {"model": self.model} | ({"language": code} if code else {})
            parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
            parts += [f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="audio"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode(), bytes(audio), f"\r\n--{mark}--\r\n".encode()]
            found = json.loads(self.post(path, b"".join(parts), f"multipart/form-data; boundary={mark}"))
            text = found.get("text") or found.get("transcript")
            if not text or not text.strip():
                raise ProviderError("the transcription is blank")
            return {"text": text, "language": found.get("language") or found.get("language_code") or code, "duration_seconds": found.get("duration"), "confidence": found.get("confidence")}

        return call

    def speak(self, path: str = "/audio/speech", voice: str = "alloy", output: str = "mp3", speed: float = 1.0) -> Callable[[str], bytes]:
        """Text to speech; the answer is the audio, or JSON with it in base64."""
        settings = {"model": self.model, "voice": params.voice(voice), "response_format": params.output_format(output), "speed": params.speed(speed)}

        def call(text: str) -> bytes:
            raw = self.post(path, json.dumps(settings | {"input": params.text(text)}).encode(), "application/json")
            if raw[:1] == b"{":
                raw = base64.b64decode(json.loads(raw)["audios"][0])
            if not raw:
                raise ProviderError("the audio is empty")
            return raw

        return call


STT_COLUMNS = {"text": "string", "language": "string", "duration_seconds": "double", "confidence": "double"}


def transcribe(rows: DataFrame, key: str, audio: str, canned: dict[bytes, str] | None = None, language: str = "en", call: Callable[[bytes], dict] | None = None, ledger: Ledger | None = None) -> DataFrame:
    """(key, text, language, duration_seconds, confidence, error) of audio that isn't empty, offline or by a call (HttpProvider.transcribe)."""
    known, code = canned or {}, params.language(language)
    offline = lambda x: {"text": known.get(bytes(x), TRANSCRIPTION), "language": code, "duration_seconds": 1.5, "confidence": 0.95}
    return _called(rows.filter(f"octet_length({audio}) > 0"), key, audio, STT_COLUMNS, lambda: call or offline, ledger, f"transcribe-{code}")


def synthesize(rows: DataFrame, key: str, text: str, format: str = "mp3", most_chars: int = params.MOST_TEXT, voice: str = "alloy", speed: float = 1.0, call: Callable[[str], bytes] | None = None, ledger: Ledger | None = None) -> DataFrame:
    """(key, audio, format, character_count, error), offline or by a call (HttpProvider.speak); blank and too long texts are left out."""
    name = params.output_format(format)
    params.voice(voice)
    params.speed(speed)
    speak = call or (lambda x: AUDIO_STUBS[name])
    made = lambda x: {"audio": speak(x), "format": name, "character_count": len(x.strip())}
    columns = {"audio": "binary", "format": "string", "character_count": "long"}
    return _called(rows.filter(f"trim({text}) <> '' AND length({text}) <= {most_chars}"), key, text, columns, lambda: made, ledger, f"speech-{name}-{voice}-{speed}")
