"""Semantic chunks of documents: sentences, vectors, breakpoints, and one ordered fold over each document's sentences.

What depends on what came before (hard cuts, joins of short sentences, length since the last break, titles that go on in the
next heading, merging of neighbours under running mean vectors) is a fold over one document, in Arrow batches. Sentences and their
joins are one fold over the text, which shuffles nothing; a model adds the vectors; and breaks, groups and merging are one fold over
the document's pieces, so that every piece is made, embedded and shuffled once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import segmentation as S

# What a heading looks like, where one goes on in the next, and titles that stand for all that begin with them.
HEADING = r"^(\s*#{1,6}\s+.+|\d+\s+[A-Z]{2,}.*|[A-Z]{3,}(\s+[A-Z]{3,})*)$"
MARKDOWN = r"^\s*#{1,6}\s+.+"
OPEN_ENDS = ("OF", "AND", "WITH", "IN", "FOR", "THE", "A")
SECTIONS = ("ABSTRACT", "INTRODUCTION", "RELATED WORK", "METHOD", "EXPERIMENT", "RESULT", "CONCLUSION", "REFERENCE", "ACKNOWLEDGMENT")
FRONT = "Front Matter"

_HEADING = re.compile(HEADING, re.MULTILINE)
Embed = Callable[[DataFrame, str, str], DataFrame]


@dataclass(frozen=True)
class Rules:
    """Sizes in characters; ``rule`` and ``value`` as in segmentation.breakpoints; ``gap`` between neighbours that still touch."""

    least: int = 100
    most: int = 800
    overlap: int = 1
    buffer: int = 1
    rule: str = "percentile"
    value: float = 0.95
    alike: float = 0.92
    gap: int = 1
    short: int = S.SHORT
    hard: int = S.HARD
    joined: int = 1000

    @property
    def hard_limit(self) -> int:
        return min(self.hard, int(1.5 * self.most)) if self.most > 0 else self.hard


@dataclass
class Piece:
    """A sentence or chunk: where it lies, whether it was cut off before the sentence's end, its section and vector."""

    start: int
    end: int
    text: str
    hard: bool = False
    section: str = FRONT
    vector: np.ndarray | None = None


def is_heading(text: str) -> bool:
    return _HEADING.match(text.strip()) is not None


def trim(text: str, start: int, hard: bool) -> Piece | None:
    """The piece without blanks around it, at its own offset, line ends as blanks; None if nothing is left."""
    bare = text.strip()
    begin = start + len(text) - len(text.lstrip())
    return Piece(begin, begin + len(bare), bare.replace("\n", " "), hard) if bare else None


def cut_long(piece: Piece, limit: int) -> list[Piece]:
    """The piece, or cuts of at most ``limit`` characters, after a blank beyond half of that if there is one; all but the last are hard."""
    text, out, at = piece.text, [], 0
    if len(text) <= limit:
        return [piece]
    while at < len(text):
        stop = at + limit
        if stop < len(text):
            blank = text.rfind(" ", at, stop)
            stop = blank + 1 if blank > at + limit // 2 else stop
        if part := trim(text[at:stop], piece.start + at, stop < len(text)):
            out.append(part)
        at = stop
    return out


def join_short(pieces: list[Piece], short: int, most: int) -> list[Piece]:
    """A short piece joins the one before, unless either is a heading, that one was cut off, or they get too long."""
    out: list[Piece] = []
    for piece in pieces:
        last = out[-1] if out else None
        if last and not last.hard and len(piece.text) < short and len(last.text) + len(piece.text) < most and not is_heading(last.text) and not is_heading(piece.text):
            out[-1] = Piece(last.start, piece.end, f"{last.text} {piece.text}", piece.hard)
        else:
            out.append(piece)
    return out


def section_title(heading: str) -> str:
    """A heading without marks: the known section it begins with, or its first part if it is long, 150 characters at most."""
    title = heading.lstrip("# ").strip()
    known = next((s for s in SECTIONS if title.upper().startswith(s)), None)
    if known:
        return known
    if len(title) > 100:
        title = re.split(r"[\n\r.:]", title)[0].strip()
    return re.sub(r"[#*_]", "", title)[:150]


@dataclass
class Titles:
    """The section that holds after each heading; an unfinished title waits for the next one, the first long one is the document's."""

    section: str = FRONT
    waiting: str = ""
    untitled: bool = True

    def read(self, heading: str) -> None:
        title = section_title(heading)
        if title.upper().endswith(OPEN_ENDS) and len(title) < 100:
            self.waiting = f"{title} "
            return
        title, self.waiting = f"{self.waiting}{title}".strip(), ""
        if self.untitled and len(title) > 10:
            self.untitled, title = False, f"TITLE: {title}"
        self.section = title


def safe_breaks(pieces: list[Piece], breaks: set[int], most: int) -> set[int]:
    """The breaks, and one after each piece with which the length since the last such piece passes 0.9 of the most, unless one is next to it."""
    more, run = set(), 0
    for place, piece in enumerate(pieces, 1):
        run += len(piece.text)
        if run > S.SAFE * most:
            if not breaks & {place - 1, place, place + 1}:
                more.add(place)
            run = 0
    return breaks | more


def group(pieces: list[Piece], breaks: set[int], overlap: int) -> list[Piece]:
    """A chunk from each break to the next, with the ``overlap`` pieces before it unless it begins with a heading."""
    titles, out = Titles(), []
    cuts = [0, *sorted(b for b in breaks if 0 < b < len(pieces)), len(pieces)]
    for first, stop in zip(cuts[:-1], cuts[1:], strict=True):
        for piece in pieces[first:stop]:
            if is_heading(piece.text):
                titles.read(piece.text.strip())
        begin = first if is_heading(pieces[first].text) else max(0, first - overlap)
        held = pieces[begin:stop]
        vector = np.mean([p.vector for p in held], axis=0) if held[0].vector is not None else None
        out.append(Piece(pieces[first].start, pieces[stop - 1].end, " ".join(p.text for p in held), pieces[stop - 1].hard, titles.section, vector))
    return out


def merge(chunks: list[Piece], rules: Rules) -> list[Piece]:
    """Touching neighbours of one section become one where the first is too small, or both are alike, and both fit.

    The merged vector is the mean by lengths, of length 1. A chunk that ends in a hard cut stays apart from the next.
    """
    out: list[Piece] = []
    for chunk in chunks:
        last = out[-1] if out else None
        touch = last is not None and not last.hard and last.section == chunk.section and 0 <= chunk.start - last.end <= rules.gap
        if touch and len(last.text) + 1 + len(chunk.text) <= rules.most:
            a, b = len(last.text), len(chunk.text)
            if a < rules.least or (last.vector is not None and float(last.vector @ chunk.vector) > rules.alike):
                vector = None
                if last.vector is not None:
                    vector = (last.vector * a + chunk.vector * b) / max(a + b, 1)
                    vector = vector / (np.linalg.norm(vector) or 1.0)
                out[-1] = replace(last, end=chunk.end, text=f"{last.text} {chunk.text}", hard=chunk.hard, vector=vector)
                continue
        out.append(replace(chunk))
    return out


# over DataFrames

_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
_PIECE = "place bigint, start bigint, end bigint, text string, hard boolean"


def _batches(made: Iterator[tuple[object, list[Piece]]], kind: pa.DataType, key: str, schema: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches of some thousand rows of the key and the ``schema``'s fields of each piece."""
    fields = [f.split()[0] for f in schema.split(", ")]
    types = {f.split()[0]: _ARROW[f.split()[-1]] for f in schema.split(", ")}
    names: list = []
    columns: dict[str, list] = {f: [] for f in fields}

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, kind), *[pa.array(columns[f], types[f]) for f in fields]], names=[key, *fields])

    for name, found in made:
        for place, piece in enumerate(found):
            names.append(name)
            for f in fields:
                columns[f].append(place if f == "place" else getattr(piece, f))
            if len(names) == S.OUT_ROWS:
                yield batch()
                names, columns = [], {f: [] for f in fields}
    if names:
        yield batch()


def _fold(df: DataFrame, key: str, lists: str, function: Callable[[list[Piece], list[bool]], list[Piece]], schema: str) -> DataFrame:
    """Rows of key and ``schema`` from each row's list of pieces (structs), which is one document's; ``function`` has the pieces and their cuts."""

    def made(batch: pa.RecordBatch) -> Iterator[tuple[object, list[Piece]]]:
        column = batch.column(1)
        ends, flat = column.offsets.to_numpy(), column.values
        has = {f.name for f in flat.type}
        for i, name in enumerate(batch.column(0).to_pylist()):
            part = flat.slice(int(ends[i]), int(ends[i + 1] - ends[i]))
            start, end = (part.field(f).to_numpy() for f in ("start", "end"))
            order = np.lexsort((end, start))
            texts, hard, cut = (part.field(f).to_pylist() if f in has else [False] * len(part) for f in ("text", "hard", "cut"))
            vectors = [None] * len(part)
            if "vector" in has:
                held = part.field("vector")
                known = held.is_valid().to_numpy(zero_copy_only=False)
                for j, v in zip(np.nonzero(known)[0], held.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(known.sum(), -1) if known.any() else (), strict=True):
                    vectors[j] = v
            found = [Piece(int(start[j]), int(end[j]), texts[j], bool(hard[j]), vector=vectors[j]) for j in order]
            yield name, function(found, [bool(cut[j]) for j in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(made(batch), batch.schema.field(0).type, key, schema)

    return df.select(key, lists).mapInArrow(run, _with_key(df, key, schema))


def _with_key(df: DataFrame, key: str, schema: str) -> str:
    return f"`{key}` {dict(df.dtypes)[key]}, " + ", ".join(f"`{f.split()[0]}` {f.split()[-1]}" for f in schema.split(", "))


def _listed(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    return rows.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("_list"))  # one document's


def pieces(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, place, start, end, text, hard: sentences, long ones cut and short ones joined."""

    def made(batch: pa.RecordBatch) -> Iterator[tuple[object, list[Piece]]]:
        for name, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = [Piece(*span) for span in S.sentence_spans(whole.as_py() or "")]
            yield name, join_short([c for p in found for c in cut_long(p, rules.hard_limit)], rules.short, rules.joined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(made(batch), batch.schema.field(0).type, key, _PIECE)

    return docs.select(key, text).mapInArrow(run, _with_key(docs, key, _PIECE))


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, place, start, end, text of the sentences as they are."""
    rows = S.sentences(docs.select(key, text), key, text).withColumnRenamed("sentence", "text")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1)


def grouped(rows: DataFrame, overlap: int = 1, key: str = "doc_id") -> DataFrame:
    """key, place, start, end, text, section: pieces (start, end, text, cut) from each cut to the next."""
    fold = lambda found, cuts: group(found, {at for at, cut in enumerate(cuts) if at and cut}, overlap)
    return _fold(_listed(rows, key, "start", "end", "text", "cut"), key, "_list", fold, "place bigint, start bigint, end bigint, text string, section string")


def routed(docs: DataFrame, embed: Embed, rules: Rules = Rules(), whole: int = 500, overlap: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, route, place, text: short documents whole, those with Markdown headings in semantic chunks, others cut recursively."""
    route = F.when(F.length(text) <= whole, "whole").when(F.regexp_like(text, F.lit(f"(?m){MARKDOWN}")), "semantic").otherwise("recursive")
    docs = docs.where(F.trim(text) != "").select(key, F.col(text).alias("text"), route.alias("route"))
    one = docs.where("route = 'whole'").select(key, "route", F.lit(0).cast("bigint").alias("place"), "text")
    semantic = chunks(docs.where("route = 'semantic'"), embed, rules, key).select(key, F.lit("semantic").alias("route"), "place", "text")
    cut = S.fold(docs.where("route = 'recursive'"), key, "text", lambda t: S.recursive_split(t, rules.most, overlap), "string")
    return one.unionByName(semantic).unionByName(cut.select(key, F.lit("recursive").alias("route"), "place", F.col("item").alias("text")))


def chunks(docs: DataFrame, embed: Embed, rules: Rules = Rules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, place, start, end, text, section, hard, vector: the semantic chunks of every document.

    ``embed(df, text column, vector column)`` adds the vectors of the pieces. Breaks are before pieces whose buffered vectors are further
    from those before than the rule allows, before Markdown headings, and where a chunk gets too long.
    """
    rows = embed(pieces(docs, rules, key, text), "text", "vector")
    marked = rows.withColumn("cut", F.regexp_like("text", F.lit(MARKDOWN)))

    def fold(found: list[Piece], cuts: list[bool]) -> list[Piece]:
        known = np.array([p.vector is not None for p in found])
        size = max((len(p.vector) for p in found if p.vector is not None), default=1)
        vectors = np.array([np.zeros(size) if p.vector is None else p.vector for p in found])
        breaks = {at for at, cut in enumerate(cuts) if at and cut} | S.far_places(vectors, known, rules.buffer, rules.rule, rules.value)
        return merge(group(found, safe_breaks(found, breaks, rules.most), rules.overlap), rules)

    return _fold(_listed(marked, key, "start", "end", "text", "hard", "vector", "cut"), key, "_list", fold, "place bigint, start bigint, end bigint, text string, section string, hard boolean, vector array<double>")


def chunks_of_pages(pages: DataFrame, embed: Embed, rules: Rules = Rules(), group_by: str = "source", page: str = "page", text: str = "text") -> DataFrame:
    """The chunks of each group's pages read on as one text, with page (the first), pages (all it overlaps) and is_cross_page."""
    kept = F.filter(F.sort_array(F.collect_list(F.struct(F.col(page).alias("page"), F.col(text).alias("text")))), lambda p: F.length(p["text"]) > 0)  # one file's pages
    files = pages.groupBy(group_by).agg(kept.alias("_p"))
    whole = files.select(group_by, F.array_join(F.transform("_p", lambda p: p["text"]), " ").alias("text")).where("text <> ''")
    found = chunks(whole, embed, rules, group_by, "text").withColumnRenamed("place", "chunk")
    spans = F.transform("_p", lambda p, i: F.struct(p["page"].alias("page"), (F.aggregate(F.slice("_p", F.lit(1), i), F.lit(0).cast("bigint"), lambda n, q: n + F.length(q["text"]) + 1)).alias("start"), F.length(p["text"]).alias("n")))
    placed = files.select(group_by, F.explode(spans).alias("s")).select(group_by, "s.page", "s.start", (F.col("s.start") + F.col("s.n")).alias("end"))
    met = S.pages_of(found.select(group_by, "chunk", "start", "end"), placed, group_by, "chunk")
    return found.join(met, [group_by, "chunk"])
