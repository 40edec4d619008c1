"""Rules that look at a question alone: what it wants, and how much sparse retrieval counts for it."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greetings of short talk, patterns of exact terms, and words that ask for meaning.
GREETINGS = ("안녕", "hi", "hello", "반가워", "누구")
EXACT_PATTERNS = (r"v?\d+\.\d+(\.\d+)?", r"[a-zA-Z]+\d+", r"0x[0-9a-fA-F]+")
MEANING_WORDS = ("차이", "작동", "이유", "철학", "설계", "구조", "개념", "설명해", "방법", "무엇", "어떻게", "장단점", "특징", "비교", "요약", "정의")


def any_of(tests: Sequence[Column]) -> Column:
    return functools.reduce(operator.or_, tests, F.lit(False))


def intent(question: Column, greetings: Sequence[str] = GREETINGS, shorter_than: int = 10) -> Column:
    """``general`` for short texts that contain a greeting, else ``rag``."""
    greets = any_of([F.contains(F.lower(question), F.lit(g)) for g in greetings])
    return F.when((F.length(question) < shorter_than) & greets, F.lit("general")).otherwise(F.lit("rag"))


def sparse_weight(
    question: Column, exact: Sequence[str] = EXACT_PATTERNS, meaning: Sequence[str] = MEANING_WORDS, exact_weight: float = 0.8, meaning_weight: float = 0.8, default: float = 0.4
) -> Column:
    """The weight of sparse retrieval; dense retrieval has the rest. A question of both kinds, or of none, keeps the default."""
    terms = any_of([F.regexp_like(question, F.lit(p)) for p in exact])
    words = any_of([F.contains(question, F.lit(w)) for w in meaning])
    return F.when(terms & ~words, F.lit(exact_weight)).when(words & ~terms, F.lit(round(1 - meaning_weight, 1))).otherwise(F.lit(default))
