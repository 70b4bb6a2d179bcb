"""Column builders for text: tokens, normal forms, overlap, quality scores, stable ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Search tokens: runs of letters and digits, as in ``[^\W_]+`` with Unicode classes.
TOKEN = r"[\p{L}\p{N}]+"
#: Sizing tokens: words with underscore, or one other sign.
SIZE_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WHITE = r"[ \t\n\r\x0b\x0c]+"


def tokens(text: Column) -> Column:
    """Lower-cased search tokens; diacritics stay. Null gives an empty list."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def size_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SIZE_TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """How many sizing tokens: what chunk sizes are measured in."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SIZE_TOKEN)).cast("long")


def content_tokens(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct search tokens of two letters or more that aren't stopwords."""
    found = F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 1))
    return F.array_except(found, F.array(*map(F.lit, stopwords))) if stopwords else found


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "))


def folded(text: Column) -> Column:
    """Collapsed, lower-cased, digits masked: how repeated margins are matched."""
    return F.regexp_replace(F.lower(collapse(text)), r"[0-9]+", "#")


def jaccard(a: Column, b: Column) -> Column:
    """Of two lists as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(part: Column, whole: Column) -> Column:
    """The share of ``part`` that ``whole`` holds; 0 for an empty ``part``."""
    n = F.size(F.array_distinct(part))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(part, whole)) / n)


def native_quality(text: Column) -> Column:
    """Length up to 500 code points, less the share of replacement signs."""
    n = F.length(text)
    bad = n - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return F.round(F.least(n / F.lit(500.0), F.lit(1.0)) * (F.lit(1.0) - bad / F.greatest(n, F.lit(1))), 4)


def needs_ocr(text: Column) -> Column:
    n = F.length(text)
    bad = n - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return (n < 100) | (bad / F.greatest(n, F.lit(1)) > 0.05)


def audit_quality(text: Column, marks: str) -> Column:
    """Stepwise score: short, faulty, or poor in the diacritics ``marks`` although it has over 50 letters."""
    n, letters = F.length(text), F.regexp_count(text, F.lit(r"\p{L}"))
    bad = (n - F.length(F.replace(text, F.lit("�"), F.lit("")))) / F.greatest(n, F.lit(1))
    diacritics = F.regexp_count(text, F.lit(f"[{marks}]")) / F.greatest(letters, F.lit(1))
    score = F.when(n < 50, 0.1).when(n < 200, 0.5).otherwise(1.0)
    score = score * F.when(bad > 0.1, 0.2).when(bad > 0.05, 0.5).otherwise(1.0)
    return F.round(score * F.when((letters > 50) & (diacritics < 0.02), 0.3).otherwise(1.0), 4)


def stable_id(prefix: str, *parts: Column) -> Column:
    """A prefix and the first 16 hex digits of the SHA-256 of the parts, which are joined by newlines."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.encode(F.concat_ws("\n", *[p.cast("string") for p in parts]), "UTF-8"), 256), 1, 16))


def _unmarked(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if unicodedata.category(c) != "Mn")
    return " ".join("".join(c if c.isalnum() else " " for c in plain).split())


@F.pandas_udf(StringType())
def normalized_question(text: pd.Series) -> pd.Series:
    """Case folded, accents dropped (canonical decomposition isn't a built-in), other signs to single spaces."""
    return text.map(lambda t: _unmarked(t) if t else "")


@F.pandas_udf(DoubleType())
def diacritic_ratio(text: pd.Series) -> pd.Series:
    """Letters that carry a combining mark over all letters."""

    def one(t: str | None) -> float:
        letters = [c for c in unicodedata.normalize("NFC", t or "") if c.isalpha()]
        return sum(len(unicodedata.normalize("NFD", c)) > 1 for c in letters) / len(letters) if letters else 0.0

    return text.map(one)
