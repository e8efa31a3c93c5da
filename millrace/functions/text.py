"""Text functions as columns. Only NFC needs Python (Spark has no such function)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship

# What Python's str.strip() removes, as a Java character class body.
STRIPPED = r"\s\x1c-\x1f"
# Separators of the lexical tokenizer.
LEXICAL_SEPARATORS = r"[\s.,!?;:\"'()\[\]{}।॥\-_/\\<>@#$%^\&*+=~`]+"
ENGLISH_STOP_WORDS = (
    "a an the is are was were be been being in on at to for of with by from and or it its this that these those has have had do does did can could will would shall should as but not so if than then there here which"
).split()
HINDI_STOP_WORDS = "है हैं था थी थे का की के में से ने पर को और या यह वह जो एक इन उन भी ही तो कर दिया लिए रहे रहा रही".split()
STOP_WORDS = ENGLISH_STOP_WORDS + HINDI_STOP_WORDS


def _compose(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def nfc(x: Column) -> Column:
    """Texts whose characters all lie below U+0300, where nothing composes, don't go to Python."""
    ship()
    return F.coalesce(F.pandas_udf(_compose, T.StringType())(F.when(x.rlike(r"[^\x00-\u02FF]"), x)), x)


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends. The first and the last character tell whether there is any, so most texts aren't searched."""
    ends = lambda v: F.concat(F.substring(v, 1, 1), F.substring(v, -1, 1))
    return F.transform(F.array(x), lambda v: F.when(ends(v).rlike(rf"(?U)[{STRIPPED}]"), F.regexp_replace(v, rf"(?U)^[{STRIPPED}]+|[{STRIPPED}]+$", "")).otherwise(v))[0]


def is_blank(x: Column) -> Column:
    """Null, empty or white space only; the search ends at the first other character."""
    return x.isNull() | ~x.rlike(rf"(?U)[^{STRIPPED}]")


def shortened(x: Column, most: int = 200) -> Column:
    """At most so many characters, with three points behind a longer text."""
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most), F.lit("...")))


def byte_size(n: Column) -> Column:
    """A number of bytes for reading, with one decimal: the first of B, KB, MB, GB, TB below 1024, else PB."""
    units = ["B", "KB", "MB", "GB", "TB"]
    shown = lambda i: F.format_string(f"%.1f {(units + ['PB'])[i]}", F.bround(n.cast("double") / F.lit(float(1024**i)), 1))
    out = F.when(n < 1024, shown(0))
    for i in range(1, len(units)):
        out = out.when(n < 1024 ** (i + 1), shown(i))
    return out.otherwise(shown(len(units)))


def normalize(x: Column, compose: bool = True) -> Column:
    """Null as empty; NFC; tab, line feed and carriage return as blanks; runs of blanks as one; stripped."""
    whole = F.coalesce(x, F.lit(""))
    whole = nfc(whole) if compose else whole
    return strip(F.regexp_replace(whole, "[ \t\n\r](?:[ \t\n\r]+|(?<! ))", " "))  # one test at most characters


def normalize_optional(x: Column, compose: bool = True) -> Column:
    return F.nullif(normalize(x, compose), F.lit(""))


def sentences(x: Column) -> Column:
    """Parts that end in a run of . ? ! or danda before white space or the end; the mark stays, blanks go."""
    marked = F.regexp_replace(x, r"([.?!।]+)(?:\s+|$)", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: strip(s)), lambda s: s != "")


def claims(x: Column, compose: bool = True) -> Column:
    """Parts after . ! ? | danda or line feed and white space, composed, normalised, without empty ones. A text that isn't blank has one at least."""
    parts = F.split(strip(nfc(x) if compose else x), r"(?U:\s)(?<=[.!?|।\n](?U:\s))(?U:\s*)")  # white space first, as the cheaper test
    return F.filter(F.transform(parts, lambda s: normalize(s, False)), lambda s: s != "")


def lexical_tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(strip(x)), LEXICAL_SEPARATORS), lambda t: t != "")


def substantive_tokens(x: Column) -> Column:
    """Distinct words without stop words, of two characters or more; digits of any length."""
    words = F.regexp_extract_all(F.lower(x), F.lit("[a-zA-Z0-9ऀ-ൿ][a-zA-Z0-9ऀ-ൿ]+|[\\p{Nd}&&[0-9ऀ-ൿ]]"), F.lit(0))
    return F.filter(F.array_distinct(words), lambda w: ~w.isin(*STOP_WORDS))


def numbers(x: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"\b\p{Nd}+(?:\.\p{Nd}+)?\b"), F.lit(0)))
    return F.when(x.rlike(r"\p{Nd}"), found).when(x.isNotNull(), F.array().cast("array<string>"))


def space_tokens(x: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(strip(x), r"(?U)\s+"), lambda t: t != "")


def redact(x: Column, secret: str) -> Column:
    return F.replace(x, F.lit(secret), F.lit("[REDACTED]")) if secret else x
