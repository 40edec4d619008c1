"""Text functions on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as T


def one(spark, function, value):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("Hello hello a 7", ["hello", "7"]),
        ("인공지능은", ["인공지능은", "인공지", "인공", "공지", "지능", "능은"]),
        ("모델은", ["모델은", "모델", "델은"]),
        ("é à", ["é", "à"]),
        ("", []),
        (None, []),
        ("x é x", ["x", "é", "x"]),
    ],
)
def test_index_tokens(spark, text, tokens):
    assert one(spark, T.index_tokens, text) == tokens


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (T.squeeze, " a\x00b\r\n\tc  d ", "a b c d"),
        (T.clean_query, '  2) Question: "what is it"', "what is it"),
        (T.latex_delimiters, "\\(x^2\\)", "$x^2$"),
        (T.latex_delimiters, "\\[y = ax + b\\]", "$$y = ax + b$$"),
        (T.latex_delimiters, "$x$", "$x$"),
        (T.rough_tokens, "", 0),
        (T.rough_tokens, "abcdef", 3),
        (T.rough_tokens, "가나", 6),
        (T.quarter_tokens, "abc", 1),
        (T.fast_hash, "", "0" * 16),
        (T.mask, "abcd", "****"),
        (T.mask, "abcdef", "ab**ef"),
        (T.strip_answer_heading, "**Answer:** yes", "yes"),
        (T.section_title, "# Introduction to it", "Introduction"),
        (T.section_title, "## *Own* title", "Own title"),
        (T.language_guess, "한국어", "Korean"),
        (T.braces, "so {\"a\": {\"b\": 1}} then", '{"a": {"b": 1}}'),
        (T.error_text, "Read timeout", "The request took too long."),
        (T.expansion_lines, "one\n\n- two\n three ", ["one", "three"]),
    ],
)
def test_scalars(spark, function, text, want):
    assert one(spark, function, text) == want


def test_expiry_and_rate(spark):
    row = spark.range(1).select(T.expired(F.lit(0), F.lit(10), F.lit(11)).alias("a"), T.expired(F.lit(0), F.lit(0), F.lit(99)).alias("b"), T.rate(F.lit(10), F.lit(4.0)).alias("c"), T.rate(F.lit(10), F.lit(0.0)).alias("d"), T.sse(F.lit("token"), F.lit("{}"), F.lit(3)).alias("e")).first()
    assert tuple(row) == (True, False, 2.5, 0.0, "id: 3\nevent: token\ndata: {}\n\n")
