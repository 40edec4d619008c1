"""Implicit joins (inventory J), distributed bookkeeping (D) and evaluation (EV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..sources.tables import table
from .registry import REGISTRY, shared
from .text_queries import TOKENS_SQL

add = REGISTRY.add

shared("j1_hydrate_coordinates", "SELECT d.doc_id, CASE WHEN d.n_chars > 1000 THEN coalesce(l.quality, -1) ELSE -2 END AS coord FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
shared(
    "j2_citation_to_document",
    """SELECT item_id, doc_id FROM (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY CASE WHEN contains(lower(b.text), d.lang) THEN 0 ELSE 1 END, d.doc_id) AS k
    FROM {benchmark} b JOIN {documents} d ON b.item_id % 25 = d.doc_id % 25) x WHERE k = 1""",
)
shared("j6_results_by_document", "SELECT user_id, props, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, count(CASE WHEN event_type = 'view' THEN 1 END) AS views, round(max(value), 6) AS best FROM {events} GROUP BY user_id, props")


@add(
    "j3_chunk_pages",
    """WITH w AS (SELECT doc_id, chunk, chunk * 900 AS a, least(n, chunk * 900 + 900) AS b FROM (SELECT doc_id, unnest(range((length(text) + 899) // 900)) AS chunk, length(text) AS n FROM documents)),
    q AS (SELECT doc_id, page, page * 1501 AS a, least(n, page * 1501 + 1500) AS b FROM (SELECT doc_id, unnest(range((length(text) + 1500) // 1501)) AS page, length(text) AS n FROM documents))
    SELECT w.doc_id, chunk, min(page) AS page, list(page ORDER BY page) AS pages, count(*) > 1 AS is_cross_page FROM w JOIN q ON w.doc_id = q.doc_id AND w.a < q.b AND w.b > q.a GROUP BY w.doc_id, chunk""",
)
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 900 characters of each document, joined to its pages of 1500 characters and a space between."""
    from ..operators.segmentation import pages_of

    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).where("n > 0")
    at = lambda step: F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step)))
    chunks = docs.select("doc_id", "n", at(900).alias("chunk")).select("doc_id", "chunk", (F.col("chunk") * 900).alias("start"), F.least("n", F.col("chunk") * 900 + 900).alias("end"))
    pages = docs.select("doc_id", "n", at(1501).alias("page")).select("doc_id", "page", (F.col("page") * 1501).alias("start"), F.least("n", F.col("page") * 1501 + 1500).alias("end"))
    return pages_of(chunks, pages, "doc_id", "chunk")


@add("j7_passage_position")
def passage_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the words of each benchmark query start in the documents it retrieves, see position()."""
    queries = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("_d"))
    hits = R.bm25_topk(docs.withColumnRenamed("_d", "text"), queries, 25).join(queries, "query_id").join(docs, "doc_id")
    return position(hits.select("query_id", "doc_id", F.col("text").alias("_q"), "_d")).select("query_id", "doc_id", "start", "share", "loose")


def position(rows: DataFrame) -> DataFrame:
    """The rows with start, share and loose, for a passage ``_q`` in a text ``_d``.

    The first start at which 80 % or more of the passage's first 20 words match in place is taken, else the first best one,
    of those that leave room for the passage. Where no word matches at any, start is null, share 0, and ``loose`` counts the
    words of the text that are among the passage's first 50. A passage's words are runs of word characters; the text's are
    split at white space and lose all other characters.
    """
    said = F.regexp_extract_all(F.lower("_q"), F.lit(r"(?U)\w+"), F.lit(0))
    there = F.transform(F.filter(F.split("_d", r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(F.lower(w), r"(?U)\W", ""))
    words = rows.withColumns({"p": said, "w": there}).where("size(w) > 0 and size(p) > 0").withColumns({"q": F.slice("p", 1, 20), "_room": F.size("w") - F.size("p") + 1})
    same = lambda s: F.aggregate(F.zip_with("q", F.slice("w", s, F.size("q")), lambda a, b: (a == b).cast("int")), F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0)))
    starts = F.when(F.col("_room") > 0, F.sequence(F.lit(1), F.greatest("_room", F.lit(1)))).otherwise(F.array().cast("array<int>"))
    # hits of 80 % or more come first and by place, others by their matches
    rank = lambda n: F.when(n * 5 >= F.size("q") * 4, F.lit(100)).otherwise(n)
    best = F.array_max(F.transform(starts, lambda s: F.struct(rank(same(s)).alias("r"), (-s).alias("s"), same(s).alias("n"))))
    hit = F.coalesce(F.col("b.n"), F.lit(0)) > 0
    return words.withColumn("b", best).withColumns({
        "start": F.when(hit, (-F.col("b.s") - 1).cast("bigint")),
        "share": F.round(F.coalesce(F.col("b.n"), F.lit(0)) / F.size("q"), 6),
        "loose": F.when(~hit, F.size(F.filter("w", lambda x: F.array_contains(F.slice("p", 1, 50), x)))).cast("bigint"),
    }).drop("p", "w", "q", "b", "_room")


shared(
    "j8_word_boxes_to_lines",
    "SELECT l_suppkey AS page, rint(l_extendedprice / 8) * 8 AS y, min(l_quantity) AS x0, max(l_quantity + l_tax) AS x1, count(*) AS words FROM {lineitem} GROUP BY l_suppkey, rint(l_extendedprice / 8) * 8",
    "SELECT l_suppkey AS page, round_even(l_extendedprice / 8, 0) * 8 AS y, min(l_quantity) AS x0, max(l_quantity + l_tax) AS x1, count(*) AS words FROM lineitem GROUP BY l_suppkey, round_even(l_extendedprice / 8, 0) * 8",
)
shared("j9_user_role_permission", "SELECT c_custkey, r_name AS permission FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey")
shared("j10_channel_broadcast", "SELECT n_nationkey AS message, s_suppkey AS client FROM {nation} JOIN {supplier} ON n_nationkey = s_nationkey")
shared(
    "j12_highlight_evaluation",
    """SELECT u.conv_id, u.turn, round(avg(CASE WHEN contains(lower(a.text), lower(u.word)) THEN 1.0D ELSE 0.0D END), 6) AS share FROM (SELECT conv_id, turn, explode(filter(split(text, ' '), w -> w <> '')) AS word FROM {conversations} WHERE role = 'user') u
    JOIN (SELECT conv_id, turn, text FROM {conversations} WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 GROUP BY u.conv_id, u.turn""",
    """SELECT u.conv_id, u.turn, round(avg(CASE WHEN contains(lower(a.text), lower(u.word)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share FROM (SELECT conv_id, turn, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word FROM conversations WHERE role = 'user') u
    JOIN (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 GROUP BY u.conv_id, u.turn""",
)


@add("d1_batch_embed")
def batch_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.vectors import hash_embed

    return hash_embed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text").drop("text")


shared("d2_job_groups", "SELECT o_custkey AS job_group, bool_and(o_orderstatus = 'F') AS complete, count(*) AS jobs FROM {orders} GROUP BY o_custkey")
shared("d3_job_bookkeeping", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F') THEN 'refused' ELSE 'cancelled' END AS cancel FROM {orders}")
shared("d4_node_fanout", "SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM {supplier}) x WHERE k <= 5")
shared("d5_index_batches", "SELECT lang, count(DISTINCT text) AS indexed, CAST(ceil(count(DISTINCT text) / 32) AS BIGINT) AS batches FROM {documents} GROUP BY lang")
shared("d6_cache_split", "SELECT d.doc_id, CASE WHEN e.vec_id IS NULL THEN 'miss' ELSE 'hit' END AS cache FROM {documents} d LEFT JOIN {embeddings} e ON d.doc_id = e.vec_id")
shared("d7_expansion_fanout", "SELECT item_id, explode(array(text, lower(text))) AS query FROM {benchmark}", "SELECT item_id, unnest([text, lower(text)]) AS query FROM benchmark")
shared("d8_batch_size", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 128 WHEN p_size > 20 THEN 64 WHEN p_size > 10 THEN 32 ELSE 16 END AS batch FROM {part}")


_SHARE = "CASE WHEN len({q}) = 0 THEN 0 ELSE len(list_intersect({q}, {t}))::DOUBLE / len({q}) END"


@add(
    "ev1_offline_judge",
    f"""WITH p AS (SELECT a.conv_id, a.turn, {TOKENS_SQL.replace('text', 'a.text')} AS x, {TOKENS_SQL.replace('text', 'u.text')} AS q FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user')
    SELECT conv_id, turn, {_SHARE.format(q='x', t='q')} AS faithfulness, {_SHARE.format(q='q', t='x')} AS relevancy FROM p""",
)
def offline_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for a judge model: shares of the answer's terms in the question, and of the question's in the answer."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    answers = turns.where("role = 'assistant'").select("conv_id", "turn", "text")
    return answers.join(asked, ["conv_id", "turn"]).select("conv_id", "turn", R.overlap_score(F.col("text"), F.col("q")).alias("faithfulness"), R.overlap_score(F.col("q"), F.col("text")).alias("relevancy"))


shared("ev2_score_means", "SELECT round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM {labels}")
shared("ev3_grader_accuracy", "SELECT source, round(avg(CASE WHEN (n_chars > 200) = (quality = 1) THEN 1.0D ELSE 0.0D END), 6) AS accuracy FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY source", "SELECT source, round(avg(CASE WHEN (n_chars > 200) = (quality = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
shared("ev4_table_quality", "SELECT doc_id, least(100.0D, round(100 * (length(text) - length(replace(text, '|', ''))) / greatest(1, length(text) - length(replace(text, ' ', ''))), 6)) AS quality FROM {documents}", "SELECT doc_id, least(100.0::DOUBLE, round(100 * (length(text) - length(replace(text, '|', ''))) / greatest(1, length(text) - length(replace(text, ' ', ''))), 6)) AS quality FROM documents")
shared("ev5_test_set_pages", "SELECT source, min(doc_id) AS doc_id, count(*) AS pages FROM {documents} WHERE length(text) >= 200 GROUP BY source")
@add("ev7_offload_saving", "SELECT source, round(1 - CAST(sum(length(lang)) AS DOUBLE) / sum(length(lang) + length(text)), 6) AS saving FROM documents GROUP BY source")
def offload_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.round(1 - F.sum(F.length("lang")) / F.sum(F.length("lang") + F.length("text")), 6).alias("saving"))


# sources and sinks as queries
@add(
    "s1_section_scan",
    """SELECT page_id, coalesce(last_value(nullif(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '') IGNORE NULLS) OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id ROWS UNBOUNDED PRECEDING), 'Front Matter') AS section FROM pages""",
)
def section_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.segmentation import carry_forward

    pages = table(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("site"), F.nullif(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1), F.lit("")).alias("h"))
    return carry_forward(pages, "site", "page_id", F.col("h"), "Front Matter").select("page_id", "section")


shared("s2_fingerprints", "SELECT page_id, sha2(html, 256) AS hash FROM {pages}", "SELECT page_id, sha256(html) AS hash FROM pages")
shared(
    "s3_layout_probe",
    "SELECT l_orderkey AS page, count(*) > 3 AND sum(CASE WHEN l_quantity < 20 THEN 1 ELSE 0 END) > 1 AND sum(CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END) > 1 AS multi_column FROM {lineitem} GROUP BY l_orderkey",
)


@add("s13_log_scan", "SELECT event_type, max_by(CAST(json_extract_string(props, '$.k') AS BIGINT), row(ts, event_id)) AS latest FROM events GROUP BY event_type")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.logs import scan

    e = table(spark, sf_dir, "events")
    lines = e.select(F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 12, "0"), "event_type", F.get_json_object("props", "$.k")).alias("value"))
    found = scan(lines, r"^(\S+ \S+ \S+) (\S+) ([0-9]+)$", ["at", "event_type", "k"])
    return found.groupBy("event_type").agg(F.max_by(F.col("k").cast("bigint"), "at").alias("latest"))


shared("s14_report", "SELECT quality, count(*) AS n, round(avg(toxic), 6) AS toxic FROM {labels} GROUP BY quality")


@add("t12_response_key", "SELECT item_id, substr(sha256(md5(text) || ':v1'), 1, 16) AS key FROM benchmark")
def response_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.composite_key([F.md5("text"), F.lit("v1")], 16).alias("key"))
