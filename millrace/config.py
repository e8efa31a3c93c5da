"""Settings from the environment and configurations of providers, with their bounds."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from .functions import params

#: Settings are read from variables with this prefix, e.g. MILLRACE_RAG_TOP_K.
PREFIX = "MILLRACE_"


def _positive(x: float, what: str) -> None:
    if isinstance(x, bool) or not isinstance(x, int | float) or x <= 0:
        raise ValueError(f"{what} has to be positive: {x!r}")


def _one_of(x: str, allowed: tuple[str, ...], what: str) -> None:
    if x not in allowed:
        raise ValueError(f"unknown {what} {x!r}; there are {list(allowed)}")


@dataclass(frozen=True)
class EmbeddingConfig:
    provider: str = "fake"
    model: str | None = None
    dimension: int | None = None
    batch_size: int = 32
    device: str = "auto"
    normalize: bool = True

    def __post_init__(self) -> None:
        _one_of(self.provider, ("fake", "huggingface", "local", "api"), "embedding provider")
        _positive(self.batch_size, "batch size")
        if self.dimension is not None:
            _positive(self.dimension, "dimension")
        if self.device not in ("auto", "cpu", "cuda") and not (self.device.startswith("cuda:") and self.device[5:].isdigit()):
            raise ValueError(f"unknown device {self.device!r}")


@dataclass(frozen=True)
class LLMConfig:
    provider: str = "fake"
    model: str | None = None
    max_tokens: int | None = None
    temperature: float = 0.0
    top_p: float | None = None
    timeout_seconds: float = 60.0

    def __post_init__(self) -> None:
        _one_of(self.provider, ("fake", "openai_compatible", "gemini", "local"), "LLM provider")
        params.temperature(self.temperature)
        if self.top_p is not None:
            params.top_p(self.top_p)
        if self.max_tokens is not None:
            params.max_tokens(self.max_tokens)
        _positive(self.timeout_seconds, "timeout")


@dataclass(frozen=True)
class STTConfig:
    provider: str = "fake"
    model: str | None = None
    language: str | None = None
    timeout_seconds: float = 30.0
    max_audio_size_mb: float = 10.0

    def __post_init__(self) -> None:
        params.language(self.language)
        _positive(self.timeout_seconds, "timeout")
        _positive(self.max_audio_size_mb, "audio size")


@dataclass(frozen=True)
class TTSConfig:
    provider: str = "fake"
    model: str | None = None
    voice: str = "alloy"
    output_format: str = "mp3"
    speed: float = 1.0
    timeout_seconds: float = 30.0
    max_text_length: int = params.MOST_TEXT
    max_audio_size_mb: float = 10.0

    def __post_init__(self) -> None:
        params.voice(self.voice)
        params.output_format(self.output_format)
        params.speed(self.speed)
        for what in ("timeout_seconds", "max_text_length", "max_audio_size_mb"):
            _positive(getattr(self, what), what)


@dataclass(frozen=True)
class Settings:
    """Settings of a run. Keys come from the environment only and aren't shown."""

    app_name: str = "rag-backend"
    llm_provider: str = "fake"
    llm_api_key: str | None = None
    llm_base_url: str | None = None
    llm_model: str = ""
    llm_timeout_seconds: float = 60.0
    stt_provider: str = "fake"
    stt_api_key: str | None = None
    stt_base_url: str | None = None
    stt_model: str = ""
    stt_language: str | None = None
    stt_timeout_seconds: float = 30.0
    stt_max_audio_size_mb: float = 10.0
    tts_provider: str = "fake"
    tts_api_key: str | None = None
    tts_base_url: str | None = None
    tts_model: str = ""
    tts_voice: str = "alloy"
    tts_output_format: str = "wav"
    tts_speed: float = 1.0
    tts_timeout_seconds: float = 30.0
    tts_max_text_length: int = params.MOST_TEXT
    tts_max_audio_size_mb: float = 10.0
    rag_index_dir: str = "index"
    rag_vector_store: str = "parquet"
    rag_embedding_model: str = "hash"
    rag_embedding_device: str = "auto"
    rag_top_k: int = 5

    def __post_init__(self) -> None:
        for what in ("llm_timeout_seconds", "stt_timeout_seconds", "stt_max_audio_size_mb", "tts_timeout_seconds", "tts_max_text_length", "tts_max_audio_size_mb", "rag_top_k"):
            _positive(getattr(self, what), what)
        params.speed(self.tts_speed)
        params.output_format(self.tts_output_format)
        params.language(self.stt_language)

    def __repr__(self) -> str:
        shown = (f"{f.name}={'***' if f.name.endswith('_key') and getattr(self, f.name) else repr(getattr(self, f.name))}" for f in fields(self))
        return f"Settings({', '.join(shown)})"

    def embedding(self) -> EmbeddingConfig:
        return EmbeddingConfig(device=self.rag_embedding_device)

    def stt(self) -> STTConfig:
        return STTConfig(self.stt_provider, self.stt_model or None, self.stt_language, self.stt_timeout_seconds, self.stt_max_audio_size_mb)

    def tts(self) -> TTSConfig:
        return TTSConfig(self.tts_provider, self.tts_model or None, self.tts_voice, self.tts_output_format, self.tts_speed, self.tts_timeout_seconds, self.tts_max_text_length, self.tts_max_audio_size_mb)


def settings(environment: Mapping[str, str] | None = None) -> Settings:
    """Settings from the environment, by default the process's own; empty variables count as unset."""
    found = os.environ if environment is None else environment
    kinds = {"int": int, "float": float}
    given = {}
    for f in fields(Settings):
        value = found.get(PREFIX + f.name.upper(), "")
        if value:
            given[f.name] = kinds.get(str(f.type), str)(value)
    return Settings(**given)
