"""Scalar text functions as column expressions: tokens, cleaning, hashes, counts, formats. No user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The index's token classes (two Hangul syllables or Latin letters, or one digit, at least).
TOKEN = "[가-힣]{2,}|[a-z]{2,}|[0-9]+"
#: Korean particles that the index strips.
PARTICLES = ("은", "는", "이", "가", "을", "를", "의", "에", "로", "서", "들", "께서", "에서", "보다", "부터", "까지", "에게", "한테")
#: Standard section names by the words a title starts with, lower case.
SECTIONS = (("abstract", "Abstract"), ("introduction", "Introduction"), ("related work", "Related Work"), ("method", "Methods"), ("result", "Results"), ("discussion", "Discussion"), ("conclusion", "Conclusion"), ("reference", "References"))


def _hangul_parts(token: Column) -> Column:
    """A Hangul token with its stem and, from three syllables on, its bigrams. The stem drops two syllables before one."""
    ends = F.lit(False)
    for p in PARTICLES:
        ends = ends | F.endswith(token, F.lit(p))
    n = F.length(token)
    stem = F.when(ends & (n >= 4), F.substring(token, F.lit(1), n - 2)).when(ends & (n == 3), F.substring(token, F.lit(1), n - 1))
    pairs = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(token, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(token), F.when(stem.isNotNull(), F.array(stem)).otherwise(F.array().cast("array<string>")), pairs)


def index_tokens(text: Column) -> Column:
    """Distinct index terms in the order of their first place; words split at white space where there is no term at all."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: w != "")

    def terms(found: Column) -> Column:
        every = F.flatten(F.transform(found, lambda t: F.when(F.regexp_like(t, F.lit("^[가-힣]")), _hangul_parts(t)).otherwise(F.array(t))))
        parts = F.when(F.regexp_like(text, F.lit("[가-힣]")), every).otherwise(found)  # only Hangul has parts
        return F.when(F.size(found) == 0, words).otherwise(F.array_distinct(parts))

    # an entry of a list of one, so that the text is searched once and not for each use of what is found
    return F.get(F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))), terms), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space and NUL to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "\x00\r\n\t", "    "), r"\s+", " "))


def clean_query(text: Column) -> Column:
    """A query without leading numbering, bullets, labels and outer quotes."""
    out = F.trim(text)
    for pattern in (r"^\s*[0-9]+[.)]\s*", r"^\s*[-*•]\s*", r"(?i)^\s*(?:example|query|question)\s*:\s*"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, "^[\"']+|[\"']+$", ""))


# How an entry of a bibliography begins, and how an author and a year are written together.
NUMBERED = r"^\s*[\[(]?([0-9]+)[\])]?[\s.]+(.*)"
AUTHOR_YEAR = r"([A-Z][a-z]+)(?:\s+et\s+al\.)?\s*[(,]?\s*([0-9]{4})[\s)]?"


def latex_delimiters(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?s)\\\[(.*?)\\\]", r"\$\$$1\$\$")
    out = F.regexp_replace(out, r"(?s)\\\((.*?)\\\)", r"\$$1\$")
    return F.regexp_replace(out, r"\\\$", r"\$")


def rough_tokens(text: Column) -> Column:
    """A third of the ASCII characters and two and a half of each other, plus one; 0 for empty text."""
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.floor((F.length(text) - other) / F.lit(3.0) + other * F.lit(2.5)) + 1).cast("bigint")


def quarter_tokens(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("bigint")


def half_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2)).cast("bigint")


def fast_hash(text: Column, length: int = 16) -> Column:
    return F.when(F.length(text) == 0, F.lit("0" * length)).otherwise(F.substring(F.md5(text), 1, length))


def composite_key(parts: list[Column], length: int) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


def mask(text: Column) -> Column:
    """All stars up to four characters, else the first and last two kept."""
    n = F.length(text)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(text, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(text, F.lit(2))))


def strip_answer_heading(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?im)^[#*\s]*(?:answer|result|response|conclusion)[*\s]*:[*\s]*", ""))


def section_title(raw: Column) -> Column:
    """A section title without markup, mapped to a standard name by how it starts, at most 150 characters."""
    plain = F.trim(F.regexp_replace(raw, r"^#+\s*", ""))
    short = F.when(F.length(plain) > 100, F.regexp_extract(plain, r"(?s)^([^\n.:]*)", 1)).otherwise(plain)
    short = F.substring(F.trim(F.regexp_replace(short, "[#*_]", "")), 1, 150)
    out = None
    for start, name in SECTIONS:
        test = F.startswith(F.lower(plain), F.lit(start))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(short)


def language_guess(text: Column) -> Column:
    return F.when(F.regexp_like(F.substring(text, 1, 1000), F.lit("[가-힣]")), F.lit("Korean")).otherwise(F.lit("English"))


def braces(text: Column) -> Column:
    """From the first opening to the last closing brace; empty without."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def error_text(message: Column) -> Column:
    """What a user reads for an error, by what its message says."""
    low = F.lower(message)
    return (
        F.when(low.contains("timeout"), F.lit("The request took too long."))
        .when(low.contains("memory"), F.lit("There is not enough memory."))
        .when(low.contains("connection") | low.contains("refused"), F.lit("The service cannot be reached."))
        .when(low.contains("not found"), F.lit("The resource was not found."))
        .otherwise(F.lit("An unexpected error occurred."))
    )


def highlight_sentences(text: Column) -> Column:
    """Sentences worth searching for: of 20 characters or more, not numbers, captions or reference lines; else the first 150 characters."""
    plain = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), "[#*_`|]", "")
    parts = F.transform(F.split(plain, r"[.?!]\s+|\n"), lambda s: F.trim(s))
    good = F.filter(parts, lambda s: (F.length(s) >= 20) & ~F.regexp_like(s, F.lit("^[0-9 .,]+$")) & ~F.regexp_like(F.lower(s), F.lit(r"^(table|figure|fig)\b|^\[[0-9]+\]")))
    return F.when(F.size(good) > 0, good).otherwise(F.array(F.substring(F.trim(plain), 1, 150)))


def expired(created: Column, ttl: Column, now: Column) -> Column:
    return (ttl > 0) & (now - created > ttl)


def rate(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / seconds).otherwise(F.lit(0.0))


def sse(event: Column, data: Column, event_id: Column) -> Column:
    """A server-sent event as text."""
    return F.concat(F.lit("id: "), event_id.cast("string"), F.lit("\nevent: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def expansion_lines(answer: Column) -> Column:
    """The queries of an expansion answer: trimmed lines, without blank ones and bullets."""
    return F.filter(F.transform(F.split(answer, "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~F.startswith(s, F.lit("-")))


def reference_keys(text: Column) -> Column:
    """An array of key, entry, in order: numbered entries by line ([1], (1), 1.), and the first author_year of each paragraph, which stands for all of it."""
    lines = F.filter(F.split(text, "\n"), lambda l: F.regexp_like(l, F.lit(NUMBERED)))
    numbered = F.transform(lines, lambda l: F.struct(F.regexp_extract(l, NUMBERED, 1).alias("key"), F.trim(F.regexp_extract(l, NUMBERED, 2)).alias("entry")))
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.regexp_like(p, F.lit(AUTHOR_YEAR)))
    named = F.transform(paragraphs, lambda p: F.struct(F.lower(F.concat_ws("_", F.regexp_extract(p, AUTHOR_YEAR, 1), F.regexp_extract(p, AUTHOR_YEAR, 2))).alias("key"), p.alias("entry")))
    return F.concat(numbered, named)
