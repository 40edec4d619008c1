"""Quality rules: a threshold table compiled into one projection of ratios, evaluated by Spark's own functions.

The base figures are counts of the whole text. The table RULES names a ratio of them, a bound and the side that is kept;
``compile_rules`` turns any such table into columns. A row is kept when the base test passes and every rule holds.

Scale: one scan, no shuffle, no Python. Windows found twice are looked for by a hash set of the windows' hashes, and only
texts that have some are sorted, so the cost is n log n in a text's words at worst. Window hashes have 64 bits.

Null or empty text: all counts 0, base_failed. Equal rows get equal results. Other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Frequent words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for as with was on are be by this from or an at not have you which but "
    "der die das und ist in zu den mit von nicht ein eine auf für sich dem des im als auch es an er hat aus bei "
    "le la les de des et en un une que est pour dans par sur au avec pas du qui ne se plus il ce elle "
    "el los las y que en un una por con para del se es al no su lo más como"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text when ``figure`` is at least ``low`` and at most ``high`` (None: no such bound)."""

    name: str
    figure: str
    low: float | None = None
    high: float | None = None


#: Figures are SQL over the base counts and n_chars, n_lines, n_stop, n_upper, n_letters, n_bullet_lines; ratios of an empty whole are null and hold.
RULES = (
    Rule("words", "n_words", 20, 1_000_000),
    Rule("mean_word_chars", "word_chars / nullif(n_words, 0)", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols / nullif(n_words, 0)", None, 0.1),
    Rule("stop_word_share", "n_stop / nullif(n_words, 0)", 0.02, None),
    Rule("upper_share", "n_upper / nullif(n_letters, 0)", None, 0.4),
    Rule("letter_share", "n_letters / nullif(word_chars, 0)", 0.6, None),
    Rule("repeated_line_share", "n_dup_lines / nullif(n_lines, 0)", None, 0.6),
    Rule("bullet_line_share", "n_bullet_lines / nullif(n_lines, 0)", None, 0.9),
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def _covered(hashes: Column, width: int) -> Column:
    """Places that windows of ``width`` cover whose hash occurs twice or more, given the windows' hashes by place."""
    at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(pairs: Column, k: Column, other: Column) -> Column:
        return F.coalesce(F.get(pairs, other)["h"] == F.get(pairs, k)["h"], F.lit(False))

    def places(pairs: Column) -> Column:
        # -1: not repeated; the rest in order of place
        return F.sort_array(F.filter(F.transform(pairs, lambda p, k: F.when(same(pairs, k, k - 1) | same(pairs, k, k + 1), p["i"]).otherwise(F.lit(-1))), lambda i: i >= 0))

    def length(found: Column) -> Column:
        steps = F.transform(found, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(found, k + 1) - i, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)  # noqa: E731  evaluates value once
    distinct = F.size(F.array_distinct(hashes))
    return F.when(distinct == F.size(hashes), F.lit(0)).otherwise(let(at, lambda pairs: let(places(pairs), length))).cast("bigint")


def base_counts(docs: DataFrame) -> DataFrame:
    """The counts of every row of doc_id, text, from which the rules' figures are made."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select("doc_id", text.alias("_t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"), F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD))).alias("_lines"))
    stop = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    gone = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    hashes = F.when(F.size("_words") > 8, F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - 7, F.lit(1))), lambda i: F.xxhash64(F.slice("_words", i, 8)))).otherwise(F.array().cast("array<bigint>"))
    parts = parts.withColumn("_hashes", hashes)
    return parts.select(
        "doc_id",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        gone("#*$%&|<>").cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _covered(F.col("_hashes"), 8).alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("_words", lambda w: w.isin(stop))).cast("bigint").alias("n_stop"),
        _count(F.col("_t"), r"\p{Lu}").alias("n_upper"),
        _count(F.col("_t"), r"\p{L}").alias("n_letters"),
        F.size(F.filter("_lines", lambda x: F.regexp_like(x, F.lit(r"^\s*[-*•]")))).cast("bigint").alias("n_bullet_lines"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """A boolean column for each rule; true: the rule holds."""
    out = {}
    for rule in rules:
        figure, tests = F.expr(rule.figure), []
        tests += [figure >= rule.low] if rule.low is not None else []
        tests += [figure <= rule.high] if rule.high is not None else []
        both = tests[0] if len(tests) == 1 else tests[0] & tests[1]
        out[f"ok_{rule.name}"] = F.coalesce(both, F.lit(True))
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """The base counts, base_failed, kept, and the names of the rules that failed, for every row of doc_id, text."""
    counts = base_counts(docs)
    tests = compile_rules(rules)
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n[3:])) for n, c in tests.items()]))
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return (
        counts.withColumns({"base_failed": base, "failed_rules": failed})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))
    )
