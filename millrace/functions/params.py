"""Argument checks of providers; each returns the value in canonical form or raises ValueError."""

from __future__ import annotations

import re

from .audio import TTS_FORMATS

LEAST_SPEED, MOST_SPEED, MOST_TEXT = 0.25, 4.0, 4096


def _number(x: object, low: float, high: float, what: str) -> float:
    if isinstance(x, bool) or not isinstance(x, int | float) or not low <= x <= high:
        raise ValueError(f"{what} has to be a number from {low} to {high}: {x!r}")
    return float(x)


def text(x: object, most: int = MOST_TEXT, what: str = "text") -> str:
    if not isinstance(x, str) or not x.strip() or len(x) > most:
        raise ValueError(f"{what} has to be a string with words and at most {most} characters")
    return x


def language(x: str | None) -> str | None:
    if x is None:
        return None
    code = x.strip().lower() if isinstance(x, str) else ""
    if not re.fullmatch(r"[a-z]{2,3}(-[a-z]{2})?", code):
        raise ValueError(f"not a language code: {x!r}")
    return code


def speed(x: object) -> float:
    return _number(x, LEAST_SPEED, MOST_SPEED, "speed")


def temperature(x: object) -> float:
    return _number(x, 0, 2, "temperature")


def top_p(x: object) -> float:
    return _number(x, 0, 1, "top_p")


def max_tokens(x: object) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < 1:
        raise ValueError(f"max_tokens has to be a positive integer: {x!r}")
    return x


def output_format(x: object) -> str:
    name = x.strip().lower() if isinstance(x, str) else ""
    if name not in TTS_FORMATS:
        raise ValueError(f"unsupported format {x!r}; there are {sorted(TTS_FORMATS)}")
    return name


def voice(x: object) -> str:
    return text(x, 256, "voice").strip()
