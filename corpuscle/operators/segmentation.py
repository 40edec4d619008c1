"""Sentences, breakpoints, chunks and pages.

What windows can say is said by windows partitioned by document; the order-dependent folds (merging until a length is
reached, cutting long pieces) run over one document's array at a time in Arrow batches; those of chunks are in ``chunking``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

HEADER = r"^#+\s|^[0-9]+(\.[0-9]+)*\.?\s+[A-Z]|^[A-Z][A-Z\s]+$"
SHORT, HARD, SAFE = 30, 1500, 0.9
_ENDS = re.compile(r"([.?!][ \t\n\x0b\f\r]+)")
#: Rows that a fold hands back at a time.
OUT_ROWS = 2000


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, sentence: per line, after . ? ! and white space; a line between pipes is one. Offsets in the whole text, trimmed."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "_l"))
    upto = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_at", F.coalesce(F.sum(F.length("_l") + 1).over(upto), F.lit(0)))
    table_row = F.startswith(F.trim("_l"), F.lit("|")) & F.endswith(F.trim("_l"), F.lit("|"))
    parts = F.when(table_row, F.array("_l")).otherwise(F.split(F.regexp_replace("_l", r"([.?!])(\s+)", "$1$2\x01"), "\x01"))
    pieces = lines.select(key, "line", "_at", F.posexplode(parts).alias("piece", "_p"))
    upto = Window.partitionBy(key, "line").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_at") + F.coalesce(F.sum(F.length("_p")).over(upto), F.lit(0))
    return trimmed(pieces.withColumns({"_s": start}), key)


def sentence_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end and text of the sentences of one text: what ``sentences`` gives of a row, for folds that read it anyway."""
    out, at = [], 0
    for line in text.split("\n"):
        bare, begin = line.strip(" "), at
        table_row = bare.startswith("|") and bare.endswith("|")
        for part in [line] if table_row else _ENDS.sub("\\1\x01", line).split("\x01"):
            if sentence := part.strip(" "):
                start = begin + len(part) - len(part.lstrip(" "))
                out.append((start, start + len(sentence), sentence))
            begin += len(part)
        at += len(line) + 1
    return out


def trimmed(pieces: DataFrame, key: str) -> DataFrame:
    """Trim pieces (_p at _s) and move their offsets along; empty ones go."""
    lead = F.length("_p") - F.length(F.ltrim("_p"))
    begin = (F.col("_s") + lead).cast("bigint")
    return pieces.where(F.trim("_p") != "").select(key, begin.alias("start"), (begin + F.length(F.trim("_p"))).cast("bigint").alias("end"), F.trim("_p").alias("sentence"))


def is_header(sentence: Column) -> Column:
    return F.regexp_like(sentence, F.lit(HEADER))


def _framed(df: DataFrame, key: str, order: str, columns: dict[str, Callable[[WindowSpec], Column]], behind: int, ahead: int, long: bool) -> DataFrame:
    """Columns over frames along each key's rows: in blocks of the series if keys may be long, in one window if each is one document's."""
    from .series import with_frames

    if long:
        return with_frames(df, [key], [order], columns, behind, ahead)
    along = Window.partitionBy(key).orderBy(order)
    return df.withColumns({name: make(along) for name, make in columns.items()})


def buffered(df: DataFrame, key: str, order: str, vector: str, buffer: int = 1, long: bool = True) -> DataFrame:
    """Mean of the vectors at places within ``buffer``, of length 1."""
    from .vectors import doubles, normalise

    near = lambda along: F.collect_list(doubles(F.col(vector))).over(along.rowsBetween(-buffer, buffer))
    rows = _framed(df, key, order, {"_l": near}, buffer, buffer, long)
    total = F.aggregate(F.slice("_l", F.lit(2), F.size("_l")), F.get("_l", F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return rows.withColumn("_m", F.transform(total, lambda x: x / F.size("_l"))).withColumn(vector, normalise(F.col("_m"))).drop("_l", "_m")


def distances(df: DataFrame, key: str, order: str, vector: str, long: bool = True) -> DataFrame:
    """1 - inner product with the next vector; none for the last."""
    from .vectors import dot

    rows = _framed(df, key, order, {"_n": F.lead(vector).over}, 0, 1, long).where("_n is not null")
    return rows.select(key, order, F.round(1 - dot(F.col(vector), F.col("_n")), 6).alias("distance"))


def breakpoints(dist: DataFrame, key: str, order: str, rule: str, value: float) -> DataFrame:
    """Places whose distance exceeds the threshold of the rule: percentile, stddev, iqr, gradient or fixed."""
    if rule == "fixed":
        return dist.where(F.col("distance") > value)
    if rule == "gradient":
        from .series import with_frames

        base = with_frames(dist, [key], [order], {"_b": F.lag("distance").over, "_a": F.lead("distance").over}, behind=1, ahead=1)
        before, after = F.col("_b"), F.col("_a")
        base = base.withColumn("_g", F.when(before.isNull(), after - F.col("distance")).when(after.isNull(), F.col("distance") - before).otherwise((after - before) / 2))
        limit = base.groupBy(key).agg(F.percentile("_g", F.lit(value)).alias("_t"))
    else:
        figure = {
            "percentile": F.percentile("distance", F.lit(value)),
            "stddev": F.avg("distance") + value * F.stddev_pop("distance"),
            "iqr": F.avg("distance") + value * (F.percentile("distance", F.lit(0.75)) - F.percentile("distance", F.lit(0.25))),
        }[rule]
        base, limit = dist, dist.groupBy(key).agg(figure.alias("_t"))
    return base.join(limit, key).where(F.round("distance", 6) > F.round("_t", 6)).select(key, order, "distance")


def threshold(dist: np.ndarray, rule: str, value: float) -> float:
    """The threshold of ``breakpoints`` over one document's distances, which hold no NaN."""
    if rule == "fixed" or not len(dist):
        return value
    if rule == "gradient":
        return _percentile(np.gradient(dist), value) if len(dist) > 1 else np.inf
    if rule == "percentile":
        return _percentile(dist, value)
    if rule == "stddev":
        return float(dist.mean() + value * dist.std())
    return float(dist.mean() + value * (_percentile(dist, 0.75) - _percentile(dist, 0.25)))


def _percentile(values: np.ndarray, share: float) -> float:
    """As Spark's: between neighbours by their weights."""
    ranked, at = np.sort(values), (len(values) - 1) * share
    low, high = int(np.floor(at)), int(np.ceil(at))
    if low == high or ranked[low] == ranked[high]:
        return float(ranked[low])
    return float((high - at) * ranked[low] + (at - low) * ranked[high])


def _half_up(x: float, digits: int = 6) -> float:
    """As Spark's round."""
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def far_places(vectors: np.ndarray, known: np.ndarray, buffer: int, rule: str, value: float) -> set[int]:
    """Places after a breakpoint of one document: ``buffered``, ``distances`` and ``breakpoints`` over the array of its vectors.

    Sums run in the order of the columns' versions. ``known`` tells the rows that have a vector; the others are zero.
    """
    n = len(vectors)
    if n < 2:
        return set()
    total, count = np.zeros_like(vectors), np.zeros(n)
    for off in range(-min(buffer, n - 1), min(buffer, n - 1) + 1):
        to, of = slice(max(0, -off), n - max(0, off)), slice(max(0, off), n - max(0, -off))
        total[to] += vectors[of]
        count[to] += known[of]
    mean = total / np.maximum(count, 1)[:, None]
    unit = mean / np.maximum(np.sqrt(np.add.accumulate(mean * mean, axis=1)[:, -1:]), 1e-9)
    near = 1 - np.add.accumulate(unit[:-1] * unit[1:], axis=1)[:, -1]
    has = np.nonzero((count[:-1] > 0) & (count[1:] > 0))[0]
    dist = np.array([_half_up(x) for x in near[has]])
    limit = threshold(dist, rule, value)
    limit = limit if rule == "fixed" or not np.isfinite(limit) else _half_up(limit)
    return {int(at) + 1 for at in has[dist > limit]}


def groups_by_break(rows: DataFrame, key: str, order: str, is_break: Column) -> DataFrame:
    """Adds ``chunk``: the number of breaks up to a row."""
    return rows.withColumn("chunk", F.sum(F.when(is_break, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))


def carry_forward(rows: DataFrame, key: str, order: str, value: Column, default: str, name: str = "section") -> DataFrame:
    """The last non-null value so far."""
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(default)))


def merge_adjacent(rows: DataFrame, keys: list[str], gap: int = 5) -> DataFrame:
    """Runs of pieces no more than ``gap`` characters apart become one: start, end, pieces."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    new = F.coalesce(F.abs(F.col("start") - F.lag("end").over(w)) > gap, F.lit(True))
    return rows.withColumn("_new", new).withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("pieces")).drop("_run")


def merge_within_budget(rows: DataFrame, keys: list[str], text: str = "text", most: int = 1200, join_cost: int = 10, near: int = 5) -> DataFrame:
    """Hits that follow each other in their source become one text, as long as its rough tokens fit the budget.

    rows: keys (a query), source, page, section, chunk_index, start_index, end_index (may be null) and the text. A hit continues the one before, by
    source, page and index, if source, page and section are the same and the offsets are at most ``near`` apart, or, where one is
    missing, the indices at most one. A run of such hits, of one query's, is filled up one after the other: a hit that no longer fits begins anew.
    Adds pieces, tokens; start_index and chunk_index are the first's, end_index the last's.
    """
    from ..functions.text import rough_tokens

    along = Window.partitionBy(*keys).orderBy("source", "page", "chunk_index", "start_index")
    before = lambda c: F.lag(c).over(along)
    same = F.col("source").eqNullSafe(before("source")) & F.col("page").eqNullSafe(before("page")) & F.col("section").eqNullSafe(before("section"))
    end = before("end_index")
    follows = F.when(end.isNotNull() & F.col("start_index").isNotNull(), F.abs(F.col("start_index") - end) <= near).otherwise(F.abs(F.col("chunk_index") - before("chunk_index")) <= 1)
    marked = rows.withColumn("_new", F.coalesce(~(same & follows), F.lit(True))).withColumn("_run", F.sum(F.col("_new").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("chunk_index", "start_index", "end_index", F.col(text).alias("text"), F.coalesce(rough_tokens(F.col(text)), F.lit(0)).alias("tokens"))
    runs = marked.groupBy(*keys, "_run", "source", "page", "section").agg(F.sort_array(F.collect_list(item)).alias("_l"))  # hits of one query
    kind = "array<struct<chunk_index:bigint,start_index:bigint,end_index:bigint,text:string,tokens:bigint,pieces:int>>"

    def fill(done: Column, hit: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["chunk_index"], last["start_index"], F.coalesce(hit["end_index"], last["end_index"]), F.concat(last["text"], F.lit("\n\n"), hit["text"]), last["tokens"] + hit["tokens"] + join_cost, last["pieces"] + 1)
        begun = F.struct(hit["chunk_index"], hit["start_index"], hit["end_index"], hit["text"], hit["tokens"], F.lit(1))
        fits = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["tokens"] + hit["tokens"] + join_cost <= most)
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined).cast(kind))).otherwise(F.concat(done, F.array(begun).cast(kind)))

    filled = runs.withColumn("_m", F.explode(F.aggregate("_l", F.array().cast(kind), fill)))
    return filled.select(*keys, "source", "page", "section", "_m.chunk_index", "_m.start_index", "_m.end_index", F.col("_m.text").alias(text), "_m.tokens", "_m.pieces")


def pages_of_chunks(pages: DataFrame, group: str, order: str, length: Column, size: int) -> DataFrame:
    """Fixed windows of ``size`` characters over each group's pages, joined by one blank, with all pages each overlaps.

    A page names the windows it meets, so the interval join is an equi-join on the window's number.
    """
    from .series import running_total

    placed = running_total(pages.select(group, order, length.alias("_n")).where("_n > 0"), [group], [order], F.col("_n") + 1, "_from")
    met = placed.select(group, order, F.explode(F.sequence(F.expr(f"_from div {size}"), F.expr(f"(_from + _n - 1) div {size}"))).alias("chunk"))
    return met.groupBy(group, "chunk").agg(F.min(order).alias("page"), F.count(F.lit(1)).alias("pages")).withColumn("is_cross_page", F.col("pages") > 1)


def stride_chunks(text: Column, size: int = 500, overlap: int = 100) -> Column:
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / step) - 1).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


# folds over one document


def hard_split(text: str, limit: int = HARD) -> list[str]:
    """Pieces of at most ``limit`` characters: cut at the last blank if that lies beyond half of it, else at the limit."""
    out = []
    while len(text) > limit:
        at = text.rfind(" ", 0, limit)
        at = at if at > limit / 2 else limit
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


def merge_short(parts: list[str], short: int = SHORT, most: int = 1000) -> list[str]:
    """A short sentence joins the one before it, unless either is a header or they get too long."""
    header, out = re.compile(HEADER), []
    for part in parts:
        if out and len(part) < short and not header.search(part) and not header.search(out[-1]) and len(out[-1]) + len(part) < most:
            out[-1] = f"{out[-1]} {part}"
        else:
            out.append(part)
    return out


def safety_breaks(lengths: list[int], breaks: list[int], most: int = 1000) -> list[int]:
    """The breaks, and one more wherever the length since the last added one passes 0.9 of the most, unless one is next to it."""
    have, run = set(breaks), 0
    for i, n in enumerate(lengths):
        run += n
        if run > SAFE * most:
            if not have & {i - 1, i, i + 1}:
                have.add(i)
            run = 0
    return sorted(have)


def merge_chunks(chunks: list[dict], least: int = 200, most: int = 1000, gap: int = 0) -> list[dict]:
    """Neighbours of one section whose offsets touch become one while the first is under ``least`` and both fit ``most``."""
    out: list[dict] = []
    for c in chunks:
        last = out[-1] if out else None
        if last and last["section"] == c["section"] and c["start"] - last["end"] <= gap and last["end"] - last["start"] < least and c["end"] - last["start"] <= most:
            last["end"] = c["end"]
        else:
            out.append(dict(c))
    return out


def recursive_split(text: str, size: int = 500, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size`` at the coarsest separator that serves, each starting with up to ``overlap`` of the one before."""
    if len(text) <= size:
        return [text] if text else []
    sep = next(s for s in separators if s == "" or s in text)
    parts = list(text) if sep == "" else text.split(sep)
    finer = separators[separators.index(sep) + 1 :] or ("",)
    out, now = [], ""
    for part in parts:
        if len(part) > size:
            out += [now] if now else []
            out += recursive_split(part, size, overlap, finer)
            now = ""
        elif len(now) + len(sep) + len(part) <= size:
            now = f"{now}{sep}{part}" if now else part
        else:
            out.append(now)
            tail = now[-overlap:] if overlap else ""
            now = f"{tail}{sep}{part}" if tail and len(tail) + len(sep) + len(part) <= size else part
    return [*out, now] if now else out


def fold(df: DataFrame, key: str, values: str, function: Callable[[list], list], schema: str) -> DataFrame:
    """Apply a fold to the array of each row; one row for each item of its result, with its place. schema: of the item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, v in zip(batch[key], batch[values], strict=True):
                for i, item in enumerate(function(list(v) if not isinstance(v, str) else v)):
                    rows.append((k, i, item))
                    if len(rows) == OUT_ROWS:
                        yield pd.DataFrame(rows, columns=[key, "place", "item"])
                        rows = []
            yield pd.DataFrame(rows, columns=[key, "place", "item"])

    return df.select(key, values).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, place bigint, item {schema}")


def pages_of(chunks: DataFrame, pages: DataFrame, key: str, chunk: str, window: int = 4096) -> DataFrame:
    """key, chunk, page (the first), pages, is_cross_page: the pages whose interval a chunk's interval overlaps.

    Both have key, start and end (exclusive). Intervals meet by windows of offsets as well as by key, so that a long document's
    chunks are not each compared with all of its pages; a pair counts in the window where the later of the two begins.
    """
    spread = lambda df: df.withColumn("_w", F.explode(F.sequence(F.floor(F.col("start") / window), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / window))))
    c, p = spread(chunks).alias("c"), spread(pages).alias("p")
    meet = F.col(f"c.{key}").eqNullSafe(F.col(f"p.{key}")) & (F.col("c._w") == F.col("p._w")) & (F.col("c.start") < F.col("p.end")) & (F.col("c.end") > F.col("p.start"))
    once = c.join(p, meet).where(F.col("c._w") == F.floor(F.greatest("c.start", "p.start") / window))
    found = once.groupBy(F.col(f"c.{key}").alias(key), F.col(f"c.{chunk}").alias(chunk)).agg(F.sort_array(F.collect_set("p.page")).alias("pages"))
    return found.select(key, chunk, F.get("pages", F.lit(0)).alias("page"), "pages", (F.size("pages") > 1).alias("is_cross_page"))
