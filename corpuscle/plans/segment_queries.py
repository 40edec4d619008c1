"""Chunking (inventory C) over documents; vector steps over the embeddings as one sequence a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import segmentation as S
from ..operators.vectors import hash_embed, rounded
from ..sources.tables import table
from .registry import REGISTRY, shared

add = REGISTRY.add

_SENT = r"""ln AS (SELECT doc_id, unnest(l) AS l, unnest(range(len(l))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    la AS (SELECT *, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM ln),
    pc0 AS (SELECT doc_id, line, ofs, CASE WHEN starts_with(trim(l), '|') AND ends_with(trim(l), '|') THEN [l] ELSE string_split(regexp_replace(l, '([.?!])(\s+)', '\1\2' || chr(1), 'g'), chr(1)) END AS ps FROM la),
    pc AS (SELECT doc_id, line, ofs, unnest(ps) AS p, unnest(range(len(ps))) AS piece FROM pc0),
    ps AS (SELECT doc_id, p, ofs + coalesce(sum(length(p)) OVER (PARTITION BY doc_id, line ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM pc),
    sent AS (SELECT doc_id, CAST(s + length(p) - length(ltrim(p)) AS BIGINT) AS start, CAST(s + length(p) - length(ltrim(p)) + length(trim(p)) AS BIGINT) AS "end", trim(p) AS sentence FROM ps WHERE trim(p) <> '')"""


# documents with a heading before every sixth line, so that the tables have sections: titles that go on, numbered ones and known ones
_PAPERS = r"""papers AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, i: CASE (i - 1) % 24 WHEN 0 THEN '# Notes from ' || coalesce(source, '') || ' of' || chr(10) || l WHEN 6 THEN '2 ' || upper(coalesce(lang, 'xx')) || ' FINDINGS' || chr(10) || l
    WHEN 12 THEN '## Related work of others' || chr(10) || l WHEN 18 THEN 'RESULTS' || chr(10) || l ELSE l END), chr(10)) AS text FROM documents)"""


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda l, i: (
        F.when(i % 24 == 0, F.concat(F.lit("# Notes from "), F.coalesce("source", F.lit("")), F.lit(" of\n"), l))
        .when(i % 24 == 6, F.concat(F.lit("2 "), F.upper(F.coalesce("lang", F.lit("xx"))), F.lit(" FINDINGS\n"), l))
        .when(i % 24 == 12, F.concat(F.lit("## Related work of others\n"), l)).when(i % 24 == 18, F.concat(F.lit("RESULTS\n"), l)).otherwise(l)
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n").alias("text"))


_PAPER_SENT = f"{_PAPERS}, {_SENT.replace('FROM documents', 'FROM papers')}"


def _paper_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sentences(_papers(spark, sf_dir))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


add("c1_sentences", f"WITH {_SENT} SELECT * FROM sent")(_sentences)


@add("c2_hard_split")
def hard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold(table(spark, sf_dir, "documents"), "doc_id", "text", S.hard_split, "string")


@add("c2_cut_pieces")
def cut_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of at most 200 characters with the flag of those that are cut off."""
    return C.pieces(table(spark, sf_dir, "documents"), C.Rules(hard=200, short=0))


@add("c3_offsets_hold", f"WITH {_SENT} SELECT doc_id, count(*) AS sentences, bool_and(substr(text, start + 1, \"end\" - start) = sentence) AS exact FROM sent JOIN documents USING (doc_id) GROUP BY doc_id")
def offsets_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    exact = F.substring(F.col("text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) == F.col("sentence")
    return _sentences(spark, sf_dir).join(docs, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.bool_and(exact).alias("exact"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _sentences(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "sentence"))).alias("l"))  # one document's
    return grouped.select("doc_id", F.transform("l", lambda x: x["sentence"]).alias("parts"))


@add("c4_merge_short")
def merge_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold(_lists(spark, sf_dir), "doc_id", "parts", S.merge_short, "string")


@add("c4_join_short")
def join_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pieces(_papers(spark, sf_dir))


_HEADER = S.HEADER.replace("'", "''")


@add("c5_headers", f"WITH {_SENT} SELECT doc_id, start, sentence FROM sent WHERE regexp_matches(sentence, '{_HEADER}')")
def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).where(S.is_header(F.col("sentence"))).select("doc_id", "start", "sentence")


@add("c5_paper_headers", f"WITH {_PAPER_SENT} SELECT doc_id, start, sentence FROM sent WHERE regexp_matches(sentence, '{_HEADER}')")
def paper_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paper_sentences(spark, sf_dir).where(S.is_header(F.col("sentence"))).select("doc_id", "start", "sentence")


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))


_BUFFER = """nb AS (SELECT label, vec_id, list(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS l FROM embeddings),
    mn AS (SELECT label, vec_id, list_transform(range(1, 65), lambda i: list_avg(list_transform(l, lambda v: v[i]))) AS m FROM nb),
    bv AS (SELECT label, vec_id, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-9)) AS v FROM mn)"""
_DIST = """ds0 AS (SELECT label, vec_id, round(1 - list_inner_product(embedding::DOUBLE[], lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)), 6) AS distance FROM embeddings), ds AS (SELECT * FROM ds0 WHERE distance IS NOT NULL)"""


@add("c6_buffered_vectors", f"WITH {_BUFFER} SELECT label, vec_id, list_transform(v, lambda x: round(x, 6)) AS v FROM bv")
def buffered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.buffered(_sequence(spark, sf_dir), "label", "vec_id", "v").select("label", "vec_id", F.transform("v", rounded).alias("v"))


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distances(_sequence(spark, sf_dir), "label", "vec_id", "v")


add("c7_adjacent_distance", f"WITH {_DIST} SELECT * FROM ds")(_distances)

for _name, _rule, _value, _sql in (
    ("c8_breakpoints_percentile", "percentile", 0.95, "quantile_cont(distance, 0.95)"),
    ("c9_breakpoints_stddev", "stddev", 1.0, "avg(distance) + 1.0 * stddev_pop(distance)"),
    ("c10_breakpoints_iqr", "iqr", 0.5, "avg(distance) + 0.5 * (quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25))"),
    ("c12_breakpoints_fixed", "fixed", 0.9, "0.9::DOUBLE"),
):
    add(_name, f"WITH {_DIST}, t AS (SELECT label, {_sql} AS t FROM ds GROUP BY label) SELECT label, vec_id, distance FROM ds JOIN t USING (label) WHERE distance > round(t, 6)")(
        lambda spark, sf_dir, rule=_rule, value=_value: S.breakpoints(_distances(spark, sf_dir), "label", "vec_id", rule, value)
    )


@add(
    "c11_breakpoints_gradient",
    f"""WITH {_DIST}, n AS (SELECT *, lag(distance) OVER w AS b, lead(distance) OVER w AS a FROM ds WINDOW w AS (PARTITION BY label ORDER BY vec_id)), g AS (SELECT *, CASE WHEN b IS NULL THEN a - distance WHEN a IS NULL THEN distance - b ELSE (a - b) / 2 END AS g FROM n),
    t AS (SELECT label, quantile_cont(g, 0.95) AS t FROM g GROUP BY label) SELECT label, vec_id, distance FROM ds JOIN t USING (label) WHERE distance > round(t, 6)""",
)
def breakpoints_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.breakpoints(_distances(spark, sf_dir), "label", "vec_id", "gradient", 0.95)


_BREAK = "start > 0 AND regexp_matches(sentence, '^(Licensed|The|This|Le|Der|El) ')"


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_break = (F.col("start") > 0) & F.regexp_like("sentence", F.lit("^(Licensed|The|This|Le|Der|El) "))
    return S.groups_by_break(_sentences(spark, sf_dir), "doc_id", "start", is_break)


_GROUPED = f"{_SENT}, gr AS (SELECT *, sum(CASE WHEN {_BREAK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS chunk FROM sent)"


@add("c13_header_breaks", f"WITH {_PAPER_SENT} SELECT doc_id, start FROM sent WHERE start > 0 AND regexp_matches(sentence, '{C.MARKDOWN}')")
def header_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paper_sentences(spark, sf_dir).where((F.col("start") > 0) & F.regexp_like("sentence", F.lit(C.MARKDOWN))).select("doc_id", "start")


@add("c14_safety_breaks")
def safety_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _lists(spark, sf_dir).select("doc_id", F.transform("parts", lambda p: F.length(p)).alias("n"))
    return S.fold(lengths, "doc_id", "n", lambda n: S.safety_breaks(n, []), "bigint")


@add("c15_group_by_breaks", f"WITH {_GROUPED} SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, min(start) AS start, max(\"end\") AS \"end\", md5(string_agg(sentence, ' ' ORDER BY start)) AS text_md5 FROM gr GROUP BY doc_id, chunk")
def group_by_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _broken(spark, sf_dir).groupBy("doc_id", "chunk").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("start", "sentence"))).alias("l"))
    return rows.select("doc_id", "chunk", "start", "end", F.md5(F.array_join(F.transform("l", lambda x: x["sentence"]), " ")).alias("text_md5"))


_CUT = f"(start > 0 AND regexp_matches(sentence, '{C.MARKDOWN}')) OR i % 5 = 0"
_HEADING = C.HEADING.replace("'", "''")


@add(
    "c15_group_with_overlap",
    f"""WITH {_PAPER_SENT}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS i FROM sent), b AS (SELECT *, i > 0 AND ({_CUT}) AS cut FROM n), g AS (SELECT *, sum(CAST(cut AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS chunk,
    CASE WHEN cut AND NOT regexp_matches(sentence, '{_HEADING}') THEN lag(sentence) OVER (PARTITION BY doc_id ORDER BY i) || ' ' ELSE '' END AS before FROM b)
    SELECT doc_id, CAST(chunk AS BIGINT) AS place, min(start) AS start, max("end") AS "end", md5(string_agg(before || sentence, ' ' ORDER BY i)) AS text_md5 FROM g GROUP BY doc_id, chunk""",
)
def group_with_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks at headings and every fifth sentence, each with the sentence before it unless it begins with a heading."""
    rows = C.sentence_rows(_papers(spark, sf_dir))
    return C.grouped(rows.withColumn("cut", F.regexp_like("text", F.lit(C.MARKDOWN)) | (F.col("place") % 5 == 0)), overlap=1).select("doc_id", "place", "start", "end", F.md5("text").alias("text_md5"))


@add(
    "c16_section_carry",
    f"WITH {_PAPER_SENT} SELECT doc_id, start, coalesce(last_value(CASE WHEN regexp_matches(sentence, '{_HEADER}') THEN sentence END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING), 'Front Matter') AS section FROM sent",
)
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paper_sentences(spark, sf_dir)
    return S.carry_forward(rows, "doc_id", "start", F.when(S.is_header(F.col("sentence")), F.col("sentence")), "Front Matter").select("doc_id", "start", "section")


@add("c16_section_titles")
def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of each chunk between headings: cleaned titles, the unfinished ones joined with the next."""
    rows = C.sentence_rows(_papers(spark, sf_dir))
    return C.grouped(rows.withColumn("cut", F.regexp_like("text", F.lit(C.HEADING))), overlap=0).select("doc_id", "place", "start", "section")


@add("c17_semantic_chunks")
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of chunking: pieces, vectors, breaks, overlap, sections, and merging by size and by cosine."""
    found = C.chunks(_papers(spark, sf_dir), hash_embed)
    return found.select("doc_id", "place", "start", "end", "section", "hard", F.md5("text").alias("text_md5"), F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@add("c17_size_aware_merge")
def size_aware_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _broken(spark, sf_dir).groupBy("doc_id", "chunk").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    lists = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("l"))

    def merge(items: list) -> list:
        return [(c["start"], c["end"]) for c in S.merge_chunks([{"start": x["start"], "end": x["end"], "section": ""} for x in items], gap=2)]

    return S.fold(lists, "doc_id", "l", merge, "struct<start:bigint,end:bigint>").select("doc_id", "place", "item.start", "item.end")


@add(
    "c18_page_attribution",
    """WITH p AS (SELECT source, doc_id, length(text) AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM documents WHERE length(text) > 0),
    m AS (SELECT source, doc_id, unnest(range(CAST(ofs // 5000 AS BIGINT), CAST((ofs + n - 1) // 5000 AS BIGINT) + 1)) AS chunk FROM p)
    SELECT source, chunk, min(doc_id) AS page, count(*) AS pages, count(*) > 1 AS is_cross_page FROM m GROUP BY source, chunk""",
)
def page_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pages_of_chunks(table(spark, sf_dir, "documents"), "source", "doc_id", F.length("text"), 5000)


@add("c18_chunks_of_pages")
def chunks_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic chunks over files of some pages each, with all pages that a chunk overlaps."""
    pages = table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("file"), F.col("doc_id").alias("page"), "text")
    found = C.chunks_of_pages(pages, hash_embed, C.Rules(least=400), "file", "page")
    return found.select("file", "chunk", "start", "end", "page", "pages", "is_cross_page", F.md5("text").alias("text_md5"))


@add("c19_recursive_split")
def recursive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold(table(spark, sf_dir, "documents"), "doc_id", "text", S.recursive_split, "string")


@add(
    "c19_stride_split",
    "SELECT doc_id, i AS place, md5(substr(text, i * 400 + 1, 500)) AS piece_md5 FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 100) / 400.0) AS BIGINT)))) AS i FROM documents)",
)
def stride_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.stride_chunks(F.col("text"))).alias("place", "piece"))
    return pieces.select("doc_id", F.col("place").cast("bigint").alias("place"), F.md5("piece").alias("piece_md5"))


@add("c20_split_router", f"WITH {_GROUPED}, b AS (SELECT DISTINCT doc_id FROM sent WHERE {_BREAK}) SELECT doc_id, CASE WHEN length(text) <= 500 THEN 'whole' WHEN doc_id IN (SELECT doc_id FROM b) THEN 'semantic' ELSE 'recursive' END AS route FROM documents")
def split_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = _broken(spark, sf_dir).where("chunk > 0").select("doc_id").distinct().withColumn("_b", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("_n")).join(broken, "doc_id", "left")
    return docs.select("doc_id", F.when(F.col("_n") <= 500, "whole").when(F.col("_b"), "semantic").otherwise("recursive").alias("route"))


@add("c20_split_routed")
def split_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one chunk, as semantic chunks where they have headings, or as recursive pieces."""
    docs = _papers(spark, sf_dir)
    return C.routed(docs, hash_embed).select("doc_id", "route", "place", F.md5("text").alias("text_md5"))


@add(
    "c21_adjacent_merge",
    f"""WITH {_SENT}, k AS (SELECT doc_id, start, "end" FROM sent WHERE length(sentence) > 20), f AS (SELECT *, coalesce(abs(start - lag("end") OVER (PARTITION BY doc_id ORDER BY start, "end")) > 5, true) AS new FROM k),
    r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT doc_id, min(start) AS start, max("end") AS "end", count(*) AS pieces FROM r GROUP BY doc_id, run""",
)
def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_adjacent(_sentences(spark, sf_dir).where(F.length("sentence") > 20).select("doc_id", "start", "end"), ["doc_id"])


@add("c21_budget_merge")
def budget_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of papers as hits of their document, read on within 300 rough tokens."""
    rows = S.carry_forward(C.sentence_rows(_papers(spark, sf_dir)), "doc_id", "start", F.when(F.regexp_like("text", F.lit(C.HEADING)), F.col("text")), C.FRONT)
    hits = rows.select(F.col("doc_id").alias("query_id"), F.lit("papers").alias("source"), F.expr("start div 2000").alias("page"), "section", F.col("place").cast("bigint").alias("chunk_index"), F.col("start").alias("start_index"), F.col("end").alias("end_index"), "text")
    return S.merge_within_budget(hits, ["query_id"], most=300).select("query_id", "page", "section", "chunk_index", "start_index", "end_index", "pieces", "tokens")


shared(
    "c22_context_clip",
    "SELECT doc_id, md5(array_join(slice(filter(split(text, '\\n'), x -> trim(x) <> ''), 1, 5), '~')) AS clip_md5 FROM {documents}",
    "SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:5], '~')) AS clip_md5 FROM documents",
)
