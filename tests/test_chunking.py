"""Series frames, the chunking fold and the budgeted merge against plain versions."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuscle.operators import chunking as C
from corpuscle.operators import metrics, segmentation, series
from corpuscle.operators.vectors import hash_embed


@pytest.mark.parametrize(("behind", "ahead", "size"), [(1, 0, 1), (5, 0, 7), (0, 3, 4), (4, 2, 64), (50, 0, 10)])
def test_frames_equal_one_window(spark, behind, ahead, size):
    """One key holds most rows, so that it spans many ranges and blocks; times repeat."""
    rng = random.Random(behind)
    rows = [(0 if i % 9 else i % 4, rng.randrange(40), i, rng.random()) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, t int, i int, v double")
    frame = lambda w: (F.sum("v").over(w.rowsBetween(-behind, ahead)), F.collect_list("i").over(w.rowsBetween(-behind, ahead)))
    got = series.with_frames(df, ["k"], ["t", "i"], {"s": lambda w: frame(w)[0], "l": lambda w: frame(w)[1]}, behind, ahead, size)
    total, listed = frame(Window.partitionBy("k").orderBy("t", "i"))
    want = df.withColumns({"s": total, "l": listed})
    assert sorted(got.select("i", "s", "l").collect()) == sorted(want.select("i", "s", "l").collect())


def test_running_total_equals_one_window(spark):
    rows = [(0 if i % 5 else None, (i * 7) % 90, i, i % 6) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, t int, i int, v int")
    got = series.running_total(df, ["k"], ["t", "i"], F.col("v"), "s", size=8)
    want = df.withColumn("s", F.coalesce(F.sum("v").over(Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert sorted(got.select("i", "s").collect()) == sorted(want.select("i", "s").collect())


def test_no_window_of_anomalies_is_by_the_series_alone(spark):
    df = spark.createDataFrame([(1, 1.0, 1)], "k int, v double, t int")
    for found in (metrics.zscore_anomalies(df, ["k"], "v", ["t"], 5), metrics.iqr_anomalies(df, ["k"], "v", ["t"], 5), metrics.volatility(df, ["k"], "v", ["t"])):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and ("avg(" in line or "collect_list" in line or "lag(" in line):
                assert "_block" in line


# the fold


def test_long_pieces_are_cut_with_their_offsets():
    text = "A" * 2000
    cut = C.cut_long(C.Piece(7, 2007, text), 750)
    assert [(p.start, p.end, p.hard) for p in cut] == [(7, 757, True), (757, 1507, True), (1507, 2007, False)]
    words = "word " * 100
    cut = C.cut_long(C.Piece(0, len(words), words), 64)
    assert all(words[p.start : p.end] == p.text and len(p.text) <= 64 for p in cut) and cut[-1].hard is False and all(p.hard for p in cut[:-1])


def test_short_pieces_join_unless_headings_or_cut_off():
    p = lambda text, hard=False: C.Piece(0, len(text), text, hard)
    joined = lambda *pieces: [x.text for x in C.join_short(list(pieces), 30, 1000)]
    assert joined(p("A sentence that is long enough."), p("Short.")) == ["A sentence that is long enough. Short."]
    assert joined(p("# Heading"), p("Short.")) == ["# Heading", "Short."] and joined(p("Text."), p("RESULTS")) == ["Text.", "RESULTS"]
    assert joined(p("cut off he", True), p("re.")) == ["cut off he", "re."]
    assert joined(p("x" * 990), p("y" * 10)) == ["x" * 990, "y" * 10]


def test_titles_wait_and_the_first_long_one_is_the_documents():
    titles, seen = C.Titles(), []
    for heading in ("# A Study of", "# Large Things", "2 METHODS USED", "## Foo *bar*", "RESULTS AND"):
        titles.read(heading)
        seen.append(titles.section)
    assert seen == ["Front Matter", "TITLE: A Study of Large Things", "2 METHODS USED", "Foo bar", "RESULT"]
    assert C.section_title("# " + "x" * 90 + ". and more of it") == "x" * 90


def test_groups_overlap_unless_a_heading_begins_them():
    pieces = [C.Piece(i, i + 1, t, vector=np.eye(4)[i % 4]) for i, t in enumerate(["a", "b", "# C", "d", "e"])]
    got = C.group(pieces, {2, 4}, 1)
    assert [(c.text, c.start, c.end) for c in got] == [("a b", 0, 2), ("# C d", 2, 4), ("d e", 4, 5)]
    assert np.allclose(got[2].vector, (np.eye(4)[3] + np.eye(4)[0]) / 2)


def test_merge_by_size_by_cosine_and_not_over_sections_or_cuts():
    v, w = np.array([1.0, 0]), np.array([0.0, 1])
    piece = lambda a, n, vector, section="s", hard=False: C.Piece(a, a + n, "x" * n, hard, section, vector)
    rules = C.Rules(least=10, most=100, gap=0)
    sizes = lambda *p: [len(c.text) for c in C.merge(list(p), rules)]
    assert sizes(piece(0, 5, v), piece(5, 20, w)) == [26]
    assert sizes(piece(0, 20, v), piece(20, 20, w)) == [20, 20]
    assert sizes(piece(0, 20, v), piece(20, 20, v)) == [41]
    assert sizes(piece(0, 60, v), piece(60, 60, v)) == [60, 60]
    assert sizes(piece(0, 5, v), piece(5, 5, v, "t")) == [5, 5]
    assert sizes(piece(0, 5, v, hard=True), piece(5, 5, v)) == [5, 5] and sizes(piece(0, 5, v), piece(9, 5, v)) == [5, 5]
    merged = C.merge([piece(0, 5, v), piece(5, 15, w)], rules)[0]
    assert np.allclose(merged.vector, np.array([5, 15]) / np.hypot(5, 15))


def plain_chunks(text, embed, rules):
    """The chunks of one text, from the text on, in plain loops."""
    sentences, at = [], 0
    for line in text.split("\n"):
        last = 0
        for cut in [m.end() for m in re.finditer(r"(?<=[.?!])\s+", line)] + [len(line)]:
            part = line[last:cut]
            if part.strip(" "):
                lead = len(part) - len(part.lstrip(" "))
                sentences.append([at + last + lead, at + last + lead + len(part.strip(" ")), part.strip(" "), False])
            last = cut
        at += len(line) + 1
    joined = []
    heading = lambda t: bool(re.match(C.HEADING, t.strip()))
    for s in sentences:
        if joined and len(s[2]) < 30 and len(joined[-1][2]) + len(s[2]) < 1000 and not heading(joined[-1][2]) and not heading(s[2]):
            joined[-1][1], joined[-1][2] = s[1], joined[-1][2] + " " + s[2]
        else:
            joined.append(list(s))
    if not joined:
        return []
    vectors = [np.array(embed[s[2]]) for s in joined]
    near = []
    for i in range(len(joined)):
        mean = np.mean(vectors[max(0, i - 1) : i + 2], axis=0)
        near.append(mean / max(np.linalg.norm(mean), 1e-9))
    far = [round(1 - float(near[i] @ near[i + 1]), 6) for i in range(len(near) - 1)]
    breaks = {i + 1 for i, d in enumerate(far) if d > round(np.percentile(far, 100 * rules.value), 6)} if far else set()
    breaks |= {i for i, s in enumerate(joined) if i and re.match(C.MARKDOWN, s[2])}
    more, run = set(), 0
    for i, s in enumerate(joined):
        run += len(s[2])
        if run > 0.9 * rules.most:
            if not {i, i + 1, i + 2} & breaks:
                more.add(i + 1)
            run = 0
    cuts = sorted({b for b in breaks | more if b < len(joined)})
    heads = [i for i, s in enumerate(joined) if heading(s[2])]
    title = next((i for i in heads if len(joined[i][2].lstrip("# ")) > 10), None)

    def section(upto):
        last = max((i for i in heads if i < upto), default=None)
        return last if last is None else (joined[last][2], last == title)

    chunks = []
    for a, b in zip([0, *cuts], [*cuts, len(joined)], strict=True):
        first = a if heading(joined[a][2]) else max(0, a - 1)
        chunks.append([joined[a][0], joined[b - 1][1], " ".join(s[2] for s in joined[first:b]), np.mean(vectors[first:b], axis=0), section(b)])
    out = []
    for c in chunks:
        p = out[-1] if out else None
        if p and p[4] == c[4] and 0 <= c[0] - p[1] <= rules.gap and len(p[2]) + 1 + len(c[2]) <= rules.most and (len(p[2]) < rules.least or float(p[3] @ c[3]) > rules.alike):
            v = (p[3] * len(p[2]) + c[3] * len(c[2])) / (len(p[2]) + len(c[2]))
            out[-1] = [p[0], c[1], p[2] + " " + c[2], v / np.linalg.norm(v), c[4]]
        else:
            out.append(c)
    return [(c[0], c[1], c[2]) for c in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_match_a_plain_version(spark, seed):
    rng = random.Random(seed)
    sentence = lambda: " ".join(f"{rng.choice('abcdef')}{rng.randrange(9)}" for _ in range(rng.randrange(1, 20))) + rng.choice(".?!")
    texts = []
    for _ in range(12):
        lines = [rng.choice(["", "## Part one beth", "12 XYZ"]) if rng.random() < 0.2 else "  ".join(sentence() for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))]
        texts.append("\n".join(lines))
    texts += ["one only.", "", "   "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rules = C.Rules(least=60, most=300)
    pieces = [r.text for r in C.pieces(docs, rules).select("text").distinct().collect()]
    embed = {r.text: r.v for r in hash_embed(spark.createDataFrame([(p,) for p in pieces], "text string"), "text", "v").collect()}
    got = {}
    for r in C.chunks(docs, hash_embed, rules).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.text))
    assert got == {i: want for i, t in enumerate(texts) if (want := plain_chunks(t, embed, rules))}


def _axes(df, text, out):
    """Vectors by topic: group a, group b, and others."""
    low = F.lower(F.col(text))
    axis = lambda i: F.array(*[F.lit(float(i == k)) for k in range(3)])
    return df.withColumn(out, F.when(low.contains("group a"), axis(0)).when(low.contains("group b"), axis(1)).otherwise(axis(2)))


def test_chunks_overlap_across_topics(spark):
    text = " ".join(f"this is sentence {i} of group {g} and it is quite long." for g in "ab" for i in range(3))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = C.chunks(docs, _axes, C.Rules(least=0, most=300, overlap=2, rule="stddev", value=0.01)).collect()
    assert len(got) >= 2 and any("group a" in c.text and "group b" in c.text for c in got)


def test_chunks_know_all_their_pages(spark):
    pages = spark.createDataFrame([("f", i, f"Content on page {i} is long enough.") for i in (1, 2, 3)] + [("f", 4, None), ("g", 1, "")], "source string, page int, text string")
    got = C.chunks_of_pages(pages, _axes, C.Rules(least=5000, most=10_000, overlap=0)).collect()
    assert [(c.source, c.page, c.pages, c.is_cross_page) for c in got] == [("f", 1, [1, 2, 3], True)]


def test_text_without_breaks_is_cut(spark):
    docs = spark.createDataFrame([(1, "A" * 2000)], "doc_id bigint, text string")
    got = C.chunks(docs, _axes, C.Rules(least=0, most=500)).orderBy("start").collect()
    assert len(got) > 1 and max(len(c.text) for c in got) <= 1600 and [c.hard for c in got][-1] is False


def test_routes_split(spark):
    docs = spark.createDataFrame([(1, "short."), (2, "# Head\n" + "Some sentence here. " * 60), (3, "word " * 300), (4, None), (5, " ")], "doc_id bigint, text string")
    got = C.routed(docs, _axes).collect()
    assert {(r.doc_id, r.route) for r in got} == {(1, "whole"), (2, "semantic"), (3, "recursive")}
    assert max(len(r.text) for r in got if r.doc_id == 3) <= 800


# the budgeted merge


def plain_merge(hits, most):
    rough = lambda t: 0 if not t else int(sum(c < "\x80" for c in t) / 3 + sum(c >= "\x80" for c in t) * 2.5) + 1
    out = []
    for h in sorted(hits, key=lambda h: (h["source"], h["page"], h["chunk_index"], h["start_index"] if h["start_index"] is not None else -1)):
        cost, last = rough(h["text"]), out[-1] if out else None
        near = last is not None and (abs(h["start_index"] - last["end_index"]) <= 5 if h["start_index"] is not None and last["end_index"] is not None else abs(h["chunk_index"] - last["last_index"]) <= 1)
        if near and all(last[c] == h[c] for c in ("source", "page", "section")) and last["tokens"] + cost + 10 <= most:
            last |= {"text": last["text"] + "\n\n" + h["text"], "tokens": last["tokens"] + cost + 10, "end_index": h["end_index"], "last_index": h["chunk_index"], "pieces": last["pieces"] + 1}
        else:
            out.append(h | {"tokens": cost, "pieces": 1, "last_index": h["chunk_index"]})
    return sorted((h["source"], h["page"], h["section"], h["text"], h["tokens"], h["pieces"]) for h in out)


def test_budgeted_merge_matches_a_plain_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for q in range(25):
        hits = []
        for source in "ab":
            at = 0
            for i in range(rng.randrange(12)):
                n = rng.randrange(1, 120)
                offsets = (at, at + n) if source == "a" else (None, None)
                hits.append({"source": source, "page": i // 5, "section": rng.choice(["s", "s", "s", "t"]), "chunk_index": i + rng.choice([0, 0, 0, 3 * i]), "start_index": offsets[0], "end_index": offsets[1], "text": "x" * n + rng.choice(["", "é"])})
                at += n + rng.choice([0, 3, 9])
        hits = list({(h["source"], h["page"], h["chunk_index"]): h for h in hits}.values())
        rows += [(q, *h.values()) for h in hits]
        want[q] = plain_merge(hits, 120)
    df = spark.createDataFrame(rows, "query_id int, source string, page int, section string, chunk_index bigint, start_index bigint, end_index bigint, text string")
    got = {}
    for r in segmentation.merge_within_budget(df, ["query_id"], most=120).collect():
        got.setdefault(r.query_id, []).append((r.source, r.page, r.section, r.text, r.tokens, r.pieces))
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}


ODD = ["", " ", "\n", "|", "| a. b |\nOne. Two?  Three!\t\n  x  ", "a.\x01b. c", "No end\n\n# Head\nText here.  And more. ", "é. 日本. \U0001f600! x", "a.\r\nb.\x0bc.\u00a0d. e", "  | t. u |  "]


def test_spans_of_a_text_are_its_sentences(spark):
    docs = spark.createDataFrame([*enumerate(ODD), (99, None)], "doc_id bigint, text string")
    want = sorted(tuple(r) for r in segmentation.sentences(docs).collect())
    assert sorted((i, *span) for i, text in enumerate(ODD) for span in segmentation.sentence_spans(text)) == want


def test_chunks_shuffle_their_pieces_once(spark):
    """Before, sentences were split, embedded and shuffled again for distances, thresholds and chunks."""
    docs = spark.createDataFrame([(1, "One two. Three four. Five six.")], "doc_id bigint, text string")
    plan = C.chunks(docs, hash_embed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.count("Join") == 0 and plan.count("Aggregate") == 1


@pytest.mark.parametrize("rule, value", [("percentile", 0.7), ("stddev", 0.5), ("iqr", 0.5), ("gradient", 0.7), ("fixed", 0.9)])
def test_far_places_are_the_breakpoints_of_columns(spark, rule, value):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 1, (40, 6))
    vectors[7:9] = vectors[6]
    rows = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(vectors)], "doc_id bigint, place bigint, vector array<double>")
    near = segmentation.buffered(rows, "doc_id", "place", "vector", 1, long=False)
    far = segmentation.breakpoints(segmentation.distances(near, "doc_id", "place", "vector", long=False), "doc_id", "place", rule, value)
    assert segmentation.far_places(vectors, np.ones(40, bool), 1, rule, value) == {r["place"] + 1 for r in far.collect()}
