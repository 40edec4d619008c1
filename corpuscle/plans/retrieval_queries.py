"""Retrieval, ranking, fusion and vectors (inventory R, O, F, V), and the flagship hybrid query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion as U
from ..operators import retrieval as R
from ..operators import vectors as V
from ..sources.tables import table
from .registry import REGISTRY, shared
from .text_queries import TOKENS_SQL

add = REGISTRY.add
K = 25
#: Cosine from which a vector is a near duplicate.
NEAR = 0.98


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: every benchmark item whose id is divisible by 20."""
    return table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_topk(table(spark, sf_dir, "documents").select("doc_id", "text"), _queries(spark, sf_dir), K)


def _dense(spark: SparkSession, sf_dir: str, of: str = "vec_id % 20 = 0", ids: DataFrame | None = None) -> DataFrame:
    """The best vectors for each vector of the query set, or for those of it among some ids."""
    e = _vectors(spark, sf_dir)
    asked = e.where(of)
    return V.dense_topk(e, asked if ids is None else asked.join(ids, asked["vec_id"] == ids["query_id"], "left_semi"), "vec_id", "embedding", K)


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the two retrievers for the queries that have both a text and a vector."""
    dense = _dense(spark, sf_dir, ids=_queries(spark, sf_dir).select("query_id"))
    name = lambda df, node, base: df.select("query_id", F.lit(node).alias("node_id"), "doc_id", "score", (F.lit(base) + F.col("rank")).cast("bigint").alias("seq"))
    return U.merge_all(name(_sparse(spark, sf_dir), "bm25", 0), name(dense, "dense", 1000))


_BM25 = f"""t AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents), p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t),
    s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t), d AS (SELECT term, count(*) AS df FROM p GROUP BY term), i0 AS (SELECT term, df, ln(n + 0.5 - df) - ln(df + 0.5) AS idf FROM d, s),
    i AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
    q AS (SELECT item_id AS query_id, unnest({TOKENS_SQL}) AS term FROM benchmark WHERE item_id % 20 = 0),
    b0 AS (SELECT query_id, doc_id, round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score FROM q JOIN i USING (term) JOIN p USING (term), s GROUP BY query_id, doc_id),
    bm AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM b0 QUALIFY rank <= 25)"""
_DENSE = """dn AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) DESC, c.vec_id) AS INTEGER) AS rank
    FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 QUALIFY rank <= 25)"""
_HITS = f"""WITH {_BM25}, {_DENSE}, hits AS (SELECT query_id, 'bm25' AS node_id, doc_id, score, CAST(rank AS BIGINT) AS seq, rank FROM bm
    UNION ALL SELECT query_id, 'dense', doc_id, score, CAST(1000 + rank AS BIGINT), rank FROM dn WHERE query_id IN (SELECT item_id FROM benchmark WHERE item_id % 20 = 0))"""


_INDEX = f"""t AS (SELECT {TOKENS_SQL} AS t FROM documents), d AS (SELECT term, count(*) AS df FROM (SELECT unnest(t) AS term FROM t) GROUP BY term),
    i0 AS (SELECT term, df, ln((SELECT count(*) FROM documents) + 0.5 - df) - ln(df + 0.5) AS idf FROM d)"""


@add("r1_bm25_index", f"WITH {_INDEX} SELECT term, df, round(CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END, 6) AS idf FROM i0")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return R.idf_table(R.tokenized(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


@add("r2_bm25_topk", f"WITH {_BM25} SELECT * FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir)


@add("r3_dense_topk", f"WITH {_DENSE} SELECT * FROM dn")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


@add("r4_hybrid_hits", f"{_HITS} SELECT query_id, node_id, doc_id, score, seq FROM hits")
def hybrid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir)


@add("ev6_retrieval_overlap", f"{_HITS}, l AS (SELECT query_id, list(doc_id) FILTER (node_id = 'bm25' AND rank <= 3) AS a, list(doc_id) FILTER (node_id = 'dense' AND rank <= 3) AS b FROM hits GROUP BY query_id) SELECT query_id, CAST(coalesce(len(list_intersect(a, b)), 0) AS BIGINT) AS common FROM l")
def retrieval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents the first three hits of both retrievers share, for each query."""
    hits = _both(spark, sf_dir).withColumn("top", F.col("seq") % 1000 <= 3)
    nodes = hits.groupBy("query_id", "doc_id").agg(F.count_if("top").alias("n"))
    return nodes.groupBy("query_id").agg(F.count_if(F.col("n") == 2).alias("common"))


_WEIGHTS = {"bm25": 0.4, "dense": 0.6}


@add("hybrid_rrf", f"{_HITS} SELECT query_id, doc_id, round(sum(CASE node_id WHEN 'bm25' THEN 0.4 ELSE 0.6 END::DOUBLE / (60 + rank)), 9) AS score, count(*) AS nodes FROM hits GROUP BY query_id, doc_id")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: sparse and dense retrieval fused by weighted reciprocal ranks."""
    return U.rrf(_both(spark, sf_dir), _WEIGHTS)


@add(
    "hybrid_rrf_faithful",
    f"{_HITS}, l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS p FROM hits) SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + max(p)), 9) AS score FROM l GROUP BY query_id, doc_id",
)
def hybrid_rrf_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.rrf_of_one_list(_both(spark, sf_dir))


@add("r5_pseudo_scores", f"WITH {_BM25} SELECT query_id, doc_id, rank, round(greatest(0.0::DOUBLE, 1 - 0.1::DOUBLE * (rank - 1)), 6) AS score FROM bm")
def pseudo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pseudo_scores(_sparse(spark, sf_dir))


def _lexical(spark: SparkSession, sf_dir: str):
    """Scores hits by shared terms of the query and the document."""

    def score(hits: DataFrame) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        queries = _queries(spark, sf_dir).withColumnRenamed("text", "_q")
        return hits.join(queries, "query_id").join(docs, "doc_id").withColumn("rerank_score", R.overlap_score(F.col("_q"), F.col("text"))).drop("_q", "text")

    return score


_TERMS = f"(SELECT doc_id, {TOKENS_SQL} AS t FROM documents)"
_LEXICAL = f"""WITH {_BM25}, qt AS (SELECT item_id AS query_id, {TOKENS_SQL} AS qt FROM benchmark),
    sc AS (SELECT bm.*, round(len(list_intersect(qt, t.t)) / CAST(len(qt) AS DOUBLE), 6) AS rs FROM bm JOIN qt USING (query_id) JOIN t USING (doc_id))"""


@add("r6_lexical_rerank", f"{_LEXICAL} SELECT query_id, doc_id, rank AS old_rank, rs AS score FROM sc")
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _lexical(spark, sf_dir)(_sparse(spark, sf_dir))
    return scored.select("query_id", "doc_id", F.col("rank").alias("old_rank"), F.round("rerank_score", 6).alias("score"))


@add(
    "r7_rerank_router",
    f"""{_LEXICAL}, w AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS s1, coalesce(max(CASE WHEN rank = 2 THEN score END) OVER (PARTITION BY query_id), 0) AS s2, count(*) OVER (PARTITION BY query_id) AS n FROM sc),
    r AS (SELECT query_id, doc_id, rank AS old_rank, CASE WHEN n = 1 THEN 'single' WHEN s1 >= 0.95 AND s1 - s2 >= 0.3 THEN 'early' ELSE 'semantic' END AS route, score, rs FROM w)
    SELECT query_id, doc_id, old_rank, route, CASE WHEN route = 'semantic' THEN rs ELSE score END AS score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN route = 'semantic' THEN rs ELSE score END DESC, doc_id) <= 15""",
)
def rerank_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rerank(_sparse(spark, sf_dir), _lexical(spark, sf_dir), 15).select("query_id", "doc_id", "old_rank", "route", "score")


@add(
    "r8_diversity_rerank",
    f"""WITH {_BM25}, h AS (SELECT bm.*, t.t FROM bm JOIN t USING (doc_id)),
    j AS (SELECT a.query_id, a.doc_id, a.score, a.rank, sum(CASE WHEN b.rank < a.rank THEN len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) ELSE 0 END) AS s FROM h a JOIN h b USING (query_id) GROUP BY ALL)
    SELECT query_id, doc_id, rank, round(0.7 * score + (1 - 0.7::DOUBLE) * (1 - s * 0.1::DOUBLE), 6) AS score FROM j""",
)
def diversity_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.index_tokens(F.col("text")).alias("terms"))
    return R.diversity(_sparse(spark, sf_dir).join(docs, "doc_id"), "terms")


@add("r10_multi_query_search", f"WITH {_BM25} SELECT query_id, count(*) AS hits, min(score) AS lowest, max(score) AS highest FROM bm GROUP BY query_id")
def multi_query_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


@add(
    "r11_dynamic_limit",
    f"""WITH {_DENSE}, w AS (SELECT *, max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY query_id) AS a, max(CASE WHEN rank = 5 THEN score END) OVER (PARTITION BY query_id) AS b FROM dn)
    SELECT query_id, doc_id, score, rank FROM w WHERE NOT coalesce((a - b) / nullif(a, 0) > 0.5, false) OR rank <= 10""",
)
def dynamic_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dynamic_limit(_dense(spark, sf_dir), ["query_id"])


_SETTINGS = [(0.2, 0.8), (0.4, 0.6), (0.8, 0.2)]


@add(
    "r12_weight_comparison",
    f"""{_HITS}, w AS (SELECT * FROM (VALUES (0.2::DOUBLE, 0.8::DOUBLE), (0.4::DOUBLE, 0.6::DOUBLE), (0.8::DOUBLE, 0.2::DOUBLE)) v(sparse, dense)), f AS (SELECT sparse, query_id, doc_id, round(sum(CASE node_id WHEN 'bm25' THEN sparse ELSE dense END / (60 + rank)), 9) AS score FROM hits, w GROUP BY ALL)
    SELECT sparse, query_id, doc_id, score FROM f QUALIFY row_number() OVER (PARTITION BY sparse, query_id ORDER BY score DESC, doc_id) <= 5""",
)
def weight_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _both(spark, sf_dir)
    runs = [R.topk(U.rrf(hits, {"bm25": s, "dense": d}), ["query_id"], 5).select(F.lit(s).alias("sparse"), "query_id", "doc_id", "score") for s, d in _SETTINGS]
    return U.merge_all(*runs)


# sorts and limits
shared("o1_top_scores", "SELECT event_id, value FROM {events} ORDER BY value DESC, event_id LIMIT 25")
shared("o2_smallest_scores", "SELECT event_id, value FROM {events} ORDER BY value, event_id LIMIT 25")
shared("o3_topk_per_node", "SELECT event_type, event_id, value FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM {events}) x WHERE k <= 5")
shared("o4_priority_queue", "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) AS place FROM {orders}", "SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) AS INTEGER) AS place FROM orders")
shared("o5_best_node", "SELECT s_nationkey, min_by(s_suppkey, struct(s_acctbal, s_suppkey)) AS best FROM {supplier} WHERE s_acctbal > 0 GROUP BY s_nationkey", "SELECT s_nationkey, min_by(s_suppkey, row(s_acctbal, s_suppkey)) AS best FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey")
shared("o6_nodes_by_load", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place FROM {supplier}", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS INTEGER) AS place FROM supplier")
shared("o7_last_n", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {events}) x WHERE k <= 10")
shared("o8_config_ranking", "SELECT p_partkey, round(0.7D * p_size + 0.3D * least(100, 700 / p_retailprice), 6) AS score FROM {part}", "SELECT p_partkey, round(0.7::DOUBLE * p_size + 0.3::DOUBLE * least(100, 700 / p_retailprice), 6) AS score FROM part")

# fusion over hits made of events: a user's query, a node for each type, documents named by the property
_EVENT_HITS = "SELECT user_id AS query_id, event_type AS node_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id, value / 100 AS score, event_id AS seq FROM events"


def _event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("node_id"), F.get_json_object("props", "$.k").cast("bigint").alias("doc_id"), (F.col("value") / 100).alias("score"), F.col("event_id").alias("seq"))


_KEYED = ["query_id", "doc_id"]


@add("f1_merge_all", f"WITH h AS ({_EVENT_HITS}) SELECT query_id, node_id, doc_id, round(score, 6) AS score FROM h UNION ALL SELECT query_id, 'again', doc_id, round(score, 6) FROM h WHERE node_id = 'click'")
def merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _event_hits(spark, sf_dir).select("query_id", "node_id", "doc_id", F.round("score", 6).alias("score"))
    return U.merge_all(h, h.where("node_id = 'click'").withColumn("node_id", F.lit("again")))


def _dedup_sql(score: str) -> str:
    return f"""WITH h AS ({_EVENT_HITS}) SELECT query_id, doc_id, round({score}, 6) AS score, array_to_string(list_sort(list_distinct(list(node_id))), ',') AS nodes, count(*) AS occurrences FROM h GROUP BY query_id, doc_id"""


for _policy, _score in (
    ("first", "arg_min(score, seq)"),
    ("highest", "max(score)"),
    ("latest", "arg_max(score, seq)"),
    ("average", "list_reduce(list(score ORDER BY seq), lambda a, x: (a + x) / 2)"),
):
    _name = "f2_dedup_by_id" if _policy == "first" else f"f7_dedup_{_policy}"
    add(_name, _dedup_sql(_score))(lambda spark, sf_dir, policy=_policy: U.dedup(_event_hits(spark, sf_dir), _KEYED, policy))


@add(
    "f3_dedup_by_content",
    "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS occurrences FROM documents GROUP BY sha256(text)",
)
def dedup_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id")
    return docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("occurrences"))


@add(
    "f3_dedup_content_and_id",
    f"""WITH h AS ({_EVENT_HITS}), c AS (SELECT *, md5(node_id || doc_id % 3) AS content FROM h), o AS (SELECT *, first_value(doc_id) OVER (PARTITION BY query_id, content ORDER BY seq) AS owner FROM c)
    SELECT query_id, owner AS doc_id, round(arg_min(score, seq), 6) AS score, array_to_string(list_sort(list_distinct(list(node_id))), ',') AS nodes, count(*) AS occurrences FROM o GROUP BY query_id, owner""",
)
def dedup_content_and_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _event_hits(spark, sf_dir).withColumn("content", F.md5(F.concat("node_id", (F.col("doc_id") % 3).cast("string"))))
    return U.dedup_content(hits, "content")


_RANKED = f"WITH h AS ({_EVENT_HITS}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY score DESC, doc_id, seq) AS rank FROM h)"


@add("f4_rrf", f"{_RANKED} SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS nodes FROM r GROUP BY query_id, doc_id")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.rrf(_event_hits(spark, sf_dir))


@add("f4_weighted_rrf", f"{_RANKED} SELECT query_id, doc_id, round(sum(CASE node_id WHEN 'click' THEN 0.3 WHEN 'view' THEN 0.7 ELSE 1.0 END::DOUBLE / (60 + rank)), 9) AS score, count(*) AS nodes FROM r GROUP BY query_id, doc_id")
def weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.rrf(_event_hits(spark, sf_dir), {"click": 0.3, "view": 0.7})


@add(
    "f5_weighted_score",
    f"""WITH h AS ({_EVENT_HITS}), l AS (SELECT query_id, doc_id, list(score * 0.5::DOUBLE ORDER BY seq) AS l FROM h GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, round(list_reduce(l, lambda a, x, i: (a + x) / i), 6) AS score FROM l""",
)
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.weighted_score(_event_hits(spark, sf_dir))


@add(
    "f6_relative_score",
    f"""WITH h AS ({_EVENT_HITS}), m AS (SELECT *, min(score) OVER (PARTITION BY query_id, node_id) AS lo, max(score) OVER (PARTITION BY query_id, node_id) AS hi FROM h)
    SELECT query_id, doc_id, round(sum((score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 6) AS score FROM m GROUP BY query_id, doc_id""",
)
def relative_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.relative_score(_event_hits(spark, sf_dir))


shared("f8_aggregation_metrics", "SELECT user_id AS query_id, count(*) AS inputs, count(DISTINCT props) AS outputs, count(*) - count(DISTINCT props) AS duplicates, count(DISTINCT event_type) AS nodes FROM {events} GROUP BY user_id")


@add("f9_content_metadata_dedup", "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text || '|' || lang || '|' || source) ORDER BY doc_id) = 1")
def content_metadata_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2(F.concat_ws("|", "text", "lang", "source"), 256).alias("_h"))
    return U.first_of(docs, [F.col("_h")], ["doc_id"]).select("doc_id", "lang", "source")


@add("f10_tuple_dedup", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text), source ORDER BY doc_id) = 1")
def tuple_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("_m"), "source")
    return U.first_of(docs, [F.col("_m"), F.col("source")], ["doc_id"]).select("doc_id")


@add(
    "f11_distributed_merge",
    f"""{_RANKED}, k AS (SELECT query_id, doc_id, max(score) AS s FROM r WHERE rank <= 5 GROUP BY query_id, doc_id) SELECT query_id, doc_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS INTEGER) AS rank FROM k QUALIFY rank <= 10""",
)
def distributed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id", "node_id").orderBy(F.desc("score"), "doc_id", "seq"))
    local = _event_hits(spark, sf_dir).withColumn("_r", rank).where("_r <= 5")
    best = local.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return R.topk(best, ["query_id"], 10).withColumn("score", F.round("score", 6))


shared(
    "f12_status_log_dedup",
    """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM (
    SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {events}) x WHERE prev IS NULL OR prev <> event_type) y WHERE k <= 30""",
)


@add("f13_simple_rrf", f"{_RANKED} SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank - 1)), 9) AS score FROM r GROUP BY query_id, doc_id")
def simple_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.rrf(_event_hits(spark, sf_dir), offset=-1).drop("nodes")


# vectors
_E = "embedding::DOUBLE[]"


@add("v1_normalise", f"SELECT vec_id, list_transform({_E}, lambda x: round(x / greatest(sqrt(list_inner_product({_E}, {_E})), 1e-9), 6)) AS unit FROM embeddings")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.transform(V.normalise(F.col("embedding")), V.rounded).alias("unit"))


_NEAR = "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.98"


@add("j4_similar_pairs", _NEAR)
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.similar_pairs(_vectors(spark, sf_dir), "vec_id", "embedding", NEAR)


@add("v2_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", V.rounded(V.cosine(F.col("embedding"), F.col("next"))).alias("cosine"))


@add("v3_embed_documents")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hash_embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


add("v4_exact_topk", f"WITH {_DENSE} SELECT query_id, doc_id, rank FROM dn")(lambda spark, sf_dir: _dense(spark, sf_dir).drop("score"))
add("v5_graph_index_topk", f"WITH {_DENSE} SELECT query_id, doc_id, score FROM dn WHERE rank <= 10")(lambda spark, sf_dir: _dense(spark, sf_dir).where("rank <= 10").drop("rank"))


@add(
    "v6_scalar_code_topk",
    f"""WITH m AS (SELECT vec_id, {_E} AS v, list_min({_E}) AS lo, (list_max({_E}) - list_min({_E})) / 255 AS sc FROM embeddings), c AS (SELECT vec_id, list_transform(v, lambda x: round_even((x - lo) / CASE WHEN sc > 0 THEN sc ELSE 1 END, 0) * CASE WHEN sc > 0 THEN sc ELSE 1 END + lo) AS v FROM m),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], c.v), 6) AS score FROM embeddings q, c WHERE q.vec_id % 20 = 0) SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 25""",
)
def scalar_code_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    coded = e.select("vec_id", V.dequantise(V.quantise(F.col("embedding"), 255)).alias("embedding"))
    return V.dense_topk(coded, e.where("vec_id % 20 = 0").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "vec_id", "embedding", K)


shared("v8_index_tier", "SELECT label, CASE WHEN count(*) < 500 THEN 'flat' WHEN count(*) < 5000 THEN 'graph' WHEN count(*) < 20000 THEN 'graph8' ELSE 'cells8' END AS tier FROM {embeddings} GROUP BY label")


def _quant_sql(levels: int) -> str:
    return f"""WITH m AS (SELECT vec_id, {_E} AS v, list_min({_E}) AS lo, list_max({_E}) AS hi FROM embeddings), s AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / {levels} ELSE 1 END AS sc FROM m)
    SELECT vec_id, list_transform(v, lambda x: CAST(round_even((x - lo) / sc, 0) AS INTEGER)) AS codes, round(sc, 6) AS scale, round(lo, 6) AS lo FROM s"""


def _quantised(spark: SparkSession, sf_dir: str, levels: int) -> DataFrame:
    q = _vectors(spark, sf_dir).select("vec_id", V.quantise(F.col("embedding"), levels).alias("q"))
    return q.select("vec_id", F.col("q.codes"), F.round("q.scale", 6).alias("scale"), V.rounded(F.col("q.offset")).alias("lo"))


add("v9_quantise_8bit", _quant_sql(255))(lambda spark, sf_dir: _quantised(spark, sf_dir, 255))
add("v10_quantise_4bit", _quant_sql(15))(lambda spark, sf_dir: _quantised(spark, sf_dir, 15))


@add(
    "v11_dequantise",
    f"""WITH m AS (SELECT vec_id, {_E} AS v, list_min({_E}) AS lo, list_max({_E}) AS hi FROM embeddings), s AS (SELECT *, (hi - lo) / 255 AS sc FROM m)
    SELECT vec_id, list_transform(v, lambda x: round(round_even((x - lo) / sc, 0) * sc + lo, 6)) AS v FROM s""",
)
def dequantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = V.dequantise(V.quantise(F.col("embedding"), 255))
    return _vectors(spark, sf_dir).select("vec_id", F.transform(back, V.rounded).alias("v"))


_SLICES = ", ".join(f"(list_position(list_transform(v[{16 * i + 1}:{16 * i + 16}], lambda x: round(abs(x - list_sum(v[{16 * i + 1}:{16 * i + 16}]) / 16), 9)), list_min(list_transform(v[{16 * i + 1}:{16 * i + 16}], lambda x: round(abs(x - list_sum(v[{16 * i + 1}:{16 * i + 16}]) / 16), 9)))) - 1) % 256" for i in range(4))


@add("v12_subspace_code", f"SELECT vec_id, [{_SLICES}]::INTEGER[] AS code FROM (SELECT vec_id, {_E} AS v FROM embeddings)")
def subspace_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", V.subspace_code(F.col("embedding"), 4, 64).alias("code"))


@add("v13_near_duplicate_prune", f"SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT b FROM ({_NEAR}))")
def near_duplicate_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.prune(_vectors(spark, sf_dir), "vec_id", "embedding", NEAR).select("vec_id")


REGISTRY.add("j5_exists_earlier", f"SELECT b AS vec_id, count(*) AS earlier FROM ({_NEAR}) GROUP BY b")(
    lambda spark, sf_dir: V.similar_pairs(_vectors(spark, sf_dir), "vec_id", "embedding", NEAR).groupBy(F.col("b").alias("vec_id")).agg(F.count(F.lit(1)).alias("earlier"))
)


@add("v14_index_optimise", f"SELECT count(*) AS kept, CAST(count(*) * 64 AS BIGINT) AS code_bytes, CAST((SELECT count(*) FROM embeddings) * 256 AS BIGINT) AS float_bytes FROM embeddings WHERE vec_id NOT IN (SELECT b FROM ({_NEAR}))")
def index_optimise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    total = e.count()
    return V.prune(e, "vec_id", "embedding", NEAR).agg(F.count(F.lit(1)).alias("kept")).select("kept", (F.col("kept") * 64).alias("code_bytes"), F.lit(total * 256).cast("bigint").alias("float_bytes"))


# the same at a low threshold, at which the small tables have pairs
_NEAR_LOW = _NEAR.replace(">= 0.98", ">= 0.3")
add("j4_similar_pairs_low", _NEAR_LOW)(lambda spark, sf_dir: V.similar_pairs(_vectors(spark, sf_dir), "vec_id", "embedding", 0.3))
add("j5_exists_earlier_low", f"SELECT b AS vec_id, count(*) AS earlier FROM ({_NEAR_LOW}) GROUP BY b")(
    lambda spark, sf_dir: V.earlier_counts(_vectors(spark, sf_dir), "vec_id", "embedding", 0.3).select(F.col("b").alias("vec_id"), "earlier")
)
add("v13_prune_low", f"SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT b FROM ({_NEAR_LOW}))")(lambda spark, sf_dir: V.prune(_vectors(spark, sf_dir), "vec_id", "embedding", 0.3).select("vec_id"))


@add("v15_consensus_average", f"SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest({_E}) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i")
def consensus_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _vectors(spark, sf_dir).select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return long.groupBy("label", F.col("i").cast("bigint").alias("i")).agg(V.rounded(F.avg("x")).alias("x"))


_NEXT = "SELECT a.label, a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _next(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("label", "vec_id", "embedding", "next", V.cosine(F.col("embedding"), F.col("next")).alias("c"))


@add("v16_consensus_majority", f"SELECT label, CASE WHEN avg(c) > 0.95 THEN 'local' ELSE 'average' END AS taken FROM ({_NEXT}) GROUP BY label")
def consensus_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next(spark, sf_dir).groupBy("label").agg(F.when(F.avg("c") > 0.95, "local").otherwise("average").alias("taken"))


@add("v17_set_similarity", f"""WITH z AS (SELECT vec_id, label, CASE WHEN vec_id % 7 = 0 THEN list_transform({_E}, lambda x: 0::DOUBLE) ELSE {_E} END AS v FROM embeddings)
    SELECT a.label, round(coalesce(avg(list_cosine_similarity(a.v, b.v)) FILTER (list_max(list_transform(a.v, lambda x: abs(x))) > 0 AND list_max(list_transform(b.v, lambda x: abs(x))) > 0), 0), 6) AS similarity FROM z a JOIN z b ON b.vec_id = a.vec_id + 1 GROUP BY a.label""")
def set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector is blanked, so that pairs without a length occur; they do not count."""
    blank = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))
    e = _vectors(spark, sf_dir).withColumn("embedding", blank)
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return V.set_similarity(e.join(after, "vec_id"), ["label"], "embedding", "next")


shared(
    "v18_consistency_check",
    "SELECT label, count(*) AS n, min(size(embedding)) AS dims, sha2(array_join(sort_array(collect_list(cast(vec_id as string))), ','), 256) AS checksum FROM {embeddings} GROUP BY label",
    "SELECT label, count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS dims, sha256(string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY CAST(vec_id AS VARCHAR))) AS checksum FROM embeddings GROUP BY label",
)


@add(
    "v19_weighted_mean",
    """WITH p AS (SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] * 2 + z[2]) / 3) AS m FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, list_transform(m, lambda x: round(x / greatest(sqrt(list_inner_product(m, m)), 1e-9), 6)) AS v FROM p""",
)
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = V.weighted_mean(F.col("embedding"), F.lit(2.0), F.col("next"), F.lit(1.0))
    return _next(spark, sf_dir).select("vec_id", F.transform(merged, V.rounded).alias("v"))


@add("v7_cell_index_topk", f"WITH {_DENSE} SELECT query_id, doc_id, score, rank FROM dn")
def cell_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return V.cell_topk(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", K)


@add("v20_seeded_fallback_vector")
def seeded_fallback_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hash_embed(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", size=384).drop("text")


@add("r9_batch_rerank")
def batch_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plugins import batched

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = batched(lambda texts: [min(1.0, len(t) / 5000) for t in texts], "text", "rerank_score", "double", size=50, on_error=0.0)(_sparse(spark, sf_dir).join(docs, "doc_id")).drop("text")
    return R.topk(scored.withColumn("score", F.coalesce("rerank_score", F.lit(0.0))), ["query_id"], 5).select("query_id", "doc_id", "score", "rank")
