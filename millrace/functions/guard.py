"""Input guardrail as one column: the first rule that a query breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, normalize

# Patterns and thresholds of the guardrail.
JAILBREAK = [
    r"(?i)\b(?:ignore|disregard|forget|override|bypass)\s+(?:all\s+)?(?:previous|prior|above|system|safety|security)\s+(?:instructions|directions|rules|prompts|guidelines|filters|restrictions)\b",
    r"(?i)\b(?:you\s+are\s+now|pretend\s+(?:to\s+be|you\s+are)|act\s+as)\s+(?:dan|jailbroken|unfiltered|god\s+mode|an?\s+unrestricted)\b",
    r"(?i)\b(?:system\s+prompt|developer\s+mode|jailbreak\s+mode|override\s+your\s+rules)\b",
    r"(?i)(?:\[system\s+message\]|<\|im_start\|>system|###\s*system:)",
]
UNSAFE = [
    r"(?i)\bhow\s+to\s+(?:make|build|construct|create|manufacture|craft)\s+.*?\b(?:bomb|explosive|weapon|malware|virus)\b",
    r"(?i)\bhow\s+to\s+(?:hack|crack|breach|infiltrate)\s+.*?\b(?:bank|server|nasa|government|database|account)\b",
    r"(?i)\bhow\s+to\s+(?:commit|execute|carry\s+out|perform)\s+.*?\b(?:suicide|mass\s+shooting|terrorist|terrorism|attack|murder)\b",
    r"(?i)(?:बम\s+कैसे\s+बनाएं|हैक\s+कैसे\s+करें)",
]
REPETITION = r"(?i)([a-zA-Z0-9ऀ-ൿ])\1{7,}"
TEXT_CHARACTER = r"[a-zA-Z0-9ऀ-ൿ]"
#: Letters, numbers, Indic signs, white space and plain punctuation.
PLAIN = r"[\p{L}\p{N}ऀ-ൿ \t\n\r.,?!'\"\-;:()]"
MOST_SIGNS, LEAST_LENGTH = 0.4, 5


def verdict(query: Column, compose: bool = True) -> Column:
    """pass, or why not: empty, jailbreak, unsafe, repetition, no_text, noise."""
    x = normalize(query, compose)
    jailbreak, unsafe = (F.greatest(*[x.rlike(p) for p in patterns]) for patterns in (JAILBREAK, UNSAFE))
    signs = F.length(F.regexp_replace(x, PLAIN, ""))
    return (
        F.when(is_blank(query) | (x == ""), "empty")
        .when(jailbreak, "jailbreak")
        .when(unsafe, "unsafe")
        .when(x.rlike(REPETITION), "repetition")
        .when(~x.rlike(TEXT_CHARACTER), "no_text")
        .when((F.length(x) >= LEAST_LENGTH) & (signs / F.length(x) > MOST_SIGNS), "noise")
        .otherwise("pass")
    )
