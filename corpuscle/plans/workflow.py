"""The question-answering workflow over a batch of questions: route, retrieve, judge, rewrite once, answer (inventory G).

A question is a row. The second pass retrieves only for questions that the judge turned down, and the two passes are one
union, so no loop runs on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import plugins as P
from ..operators import fusion as U
from ..operators import retrieval as R
from ..operators import segmentation as S
from ..operators.retrieval import overlap_score
from ..operators.routing import GREETINGS, intent, sparse_weight
from ..sources.tables import table
from .metrics_queries import _EXACT, _MEANING
from .registry import REGISTRY
from .retrieval_queries import _BM25, _HITS, _WEIGHTS, _both, _queries
from .text_queries import TOKENS_SQL

add = REGISTRY.add

def _context(docs: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    hits = R.bm25_topk(docs, queries.select("query_id", "text"), 25).where(F.col("rank") <= top).join(docs, "doc_id")
    parts = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("l"))  # ``top`` texts
    return parts.select("query_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("context"))


def answer(docs: DataFrame, questions: DataFrame, cached: DataFrame | None = None, top: int = 3, least: float = 0.3) -> DataFrame:
    """query_id, route, retries, query (the one answered), answer for rows of query_id, text; cached: query_id, answer."""
    asked = questions.withColumn("route", intent(F.col("text")))
    if cached is not None:
        asked = asked.join(cached.select("query_id", F.col("answer").alias("_hit")), "query_id", "left").withColumn("route", F.when(F.col("_hit").isNotNull(), "cached").otherwise(F.col("route")))
    else:
        asked = asked.withColumn("_hit", F.lit(None).cast("string"))
    done = asked.where("route <> 'rag'").select("query_id", "route", F.lit(0).alias("retries"), F.col("text").alias("query"), F.coalesce("_hit", F.lit("Hello! Ask me about the documents.")).alias("answer"))
    first = asked.where("route = 'rag'").select("query_id", F.col("text").alias("question"))

    def judged(rows: DataFrame) -> DataFrame:
        context = _context(docs, rows.select("query_id", F.col("question").alias("text")), top)
        return P.coverage_judge(rows.join(context, "query_id", "left"), least=least)

    once = judged(first)
    rejected = once.where("not relevant").select("query_id", P.keyword_rewrite(F.col("question")).alias("question"))
    twice = judged(rejected)
    told = lambda df, n: df.select("query_id", F.lit("generate").alias("route"), F.lit(n).alias("retries"), F.col("question").alias("query"), F.coalesce(P.extractive_answer(F.col("question"), F.col("context")), F.lit("")).alias("answer"))
    return done.unionByName(told(once.where("relevant"), 0)).unionByName(told(twice, 1))


def merge_state(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Reducers: lists are appended, retries added, other values replaced where the new state has them."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in new.columns if c != key])
    out = old.join(n, key, "left")
    empty = F.array().cast("array<string>")
    return out.select(key, F.concat("search_queries", F.coalesce("_search_queries", empty)).alias("search_queries"), (F.col("retry_count") + F.coalesce("_retry_count", F.lit(0))).alias("retry_count"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, F.lit("Hi there")).otherwise(F.concat(F.lit("zzqx vvkq "), F.col("text")))
    return table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), text.alias("text"))


_GREETS = " OR ".join(f"contains(lower(q), '{g}')" for g in GREETINGS)


@add(
    "g1_preprocess",
    f"SELECT b.item_id, CASE WHEN l.doc_id IS NOT NULL THEN 'cached' WHEN length(q) < 10 AND ({_GREETS}) THEN 'general' ELSE 'rag' END AS route FROM (SELECT item_id, CASE WHEN item_id % 3 = 1 THEN 'Hi there' ELSE text END AS q FROM benchmark) b LEFT JOIN labels l ON b.item_id = l.doc_id",
)
def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route of each question; those that have a label stand for questions whose answer is cached."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 1, F.lit("Hi there")).otherwise(F.col("text")).alias("q"))
    cached = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_hit"))
    return asked.join(cached, F.col("item_id") == F.col("_hit"), "left").select("item_id", F.when(F.col("_hit").isNotNull(), F.lit("cached")).otherwise(intent(F.col("q"))).alias("route"))


def retrieve(hits: DataFrame, docs: DataFrame, questions: DataFrame, weights: dict[str, float], k: int = 5, most: int = 25) -> DataFrame:
    """The retrieve node from the hits of several retrievers (query_id, node_id, doc_id, score, seq) on: fused by weighted reciprocal
    ranks, cut where the first leads clearly, and ranked anew by what question and text share. docs: doc_id, text; questions: query_id, question.
    """
    fused = R.topk(U.rrf(hits, weights).select("query_id", "doc_id", "score"), ["query_id"], most)
    told = R.dynamic_limit(fused, ["query_id"]).join(docs, "doc_id").join(questions, "query_id")
    return R.rerank(told, lambda rows: rows.withColumn("rerank_score", overlap_score(F.col("question"), F.col("text"))), k)


def read_together(hits: DataFrame, most: int = 1200) -> DataFrame:
    """Hits (query_id, source, page, section, chunk_index, start_index, end_index, text) that follow each other as one text each, within the budget."""
    return S.merge_within_budget(hits, ["query_id"], "text", most)


_GRAPH = f"""{_HITS}, rr AS (SELECT query_id, doc_id, round(sum(CASE node_id WHEN 'bm25' THEN 0.4 ELSE 0.6 END::DOUBLE / (60 + rank)), 9) AS score FROM hits GROUP BY query_id, doc_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM rr QUALIFY rank <= 25), fl AS (SELECT *, max(score) FILTER (rank = 1) OVER w AS first, max(score) FILTER (rank = 5) OVER w AS fifth FROM rk WINDOW w AS (PARTITION BY query_id)),
    lim AS (SELECT * FROM fl WHERE NOT coalesce((first - fifth) / nullif(first, 0) > 0.5, false) OR rank <= 10),
    tx AS (SELECT l.query_id, l.doc_id, l.score, l.rank, count(*) OVER (PARTITION BY l.query_id) AS n, {TOKENS_SQL.replace('text', 'b.text')} AS q, {TOKENS_SQL.replace('text', 'd.text')} AS t FROM lim l JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = l.query_id),
    rs AS (SELECT query_id, doc_id, CASE WHEN n = 1 THEN score ELSE round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, t))::DOUBLE / len(q) END, 6) END AS score, CASE WHEN n = 1 THEN 'single' ELSE 'semantic' END AS route FROM tx)
    SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, route FROM rs QUALIFY rank <= 5"""


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = _queries(spark, sf_dir).withColumnRenamed("text", "question")
    return retrieve(_both(spark, sf_dir), docs, asked, _WEIGHTS)


@add(
    "g1_preprocess_state",
    f"""WITH a AS (SELECT b.item_id, l.doc_id IS NOT NULL AS hit, CASE b.item_id % 3 WHEN 1 THEN 'Hi there' WHEN 2 THEN 'release v1.2 ' || text ELSE text END AS q FROM benchmark b LEFT JOIN labels l ON b.item_id = l.doc_id),
    f AS (SELECT item_id, CASE WHEN hit THEN 'cached' WHEN length(q) < 10 AND ({_GREETS}) THEN 'general' ELSE 'rag' END AS route, {_EXACT} AS e, {_MEANING} AS m FROM a), w AS (SELECT item_id, route, CAST(CASE WHEN e AND NOT m THEN 0.8 WHEN m AND NOT e THEN 0.2 ELSE 0.4 END AS DOUBLE) AS bm25 FROM f)
    SELECT item_id, route, CASE WHEN route = 'rag' THEN bm25 END AS bm25, CASE WHEN route = 'rag' THEN round(1 - bm25, 6) END AS dense FROM w""",
)
def preprocess_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route of each question, and for those to be retrieved the weights of both retrievers."""
    q = F.when(F.col("item_id") % 3 == 1, F.lit("Hi there")).when(F.col("item_id") % 3 == 2, F.concat(F.lit("release v1.2 "), F.col("text"))).otherwise(F.col("text"))
    cached = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.lit(True).alias("_hit"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", q.alias("q")).join(cached, "item_id", "left")
    routed = asked.withColumn("route", F.when(F.col("_hit"), F.lit("cached")).otherwise(intent(F.col("q")))).withColumn("bm25", F.when(F.col("route") == "rag", sparse_weight(F.col("q"))))
    return routed.select("item_id", "route", "bm25", F.round(1 - F.col("bm25"), 6).alias("dense"))


@add("g2_retrieve", _GRAPH)
def retrieve_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and sparse hits, fused, limited and ranked anew."""
    return _retrieved(spark, sf_dir).select("query_id", "doc_id", "score", "rank", "route")


@add("g2_retrieve_merged")
def retrieve_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, and hits that are neighbours in their source read as one; documents of a source count as its chunks in order."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", "source", F.expr("doc_id div 8").alias("page"), F.lit("").alias("section"), F.col("doc_id").alias("chunk_index"))
    none = F.lit(None).cast("bigint")
    hits = _retrieved(spark, sf_dir).join(chunks, "doc_id").withColumns({"start_index": none, "end_index": none})
    return read_together(hits.select("query_id", "source", "page", "section", "chunk_index", "start_index", "end_index", "text")).select("query_id", "source", "page", "chunk_index", "pieces", "tokens", F.md5("text").alias("text_md5"))


_ASKED = "SELECT item_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Hi there' ELSE 'zzqx vvkq ' || text END AS text FROM benchmark WHERE item_id % 20 = 0"
_OWN = _BM25.replace("FROM benchmark WHERE item_id % 20 = 0", f"FROM ({_ASKED})")


@add(
    "g2_retrieve_and_limit",
    f"""WITH {_OWN}, f AS (SELECT *, max(score) FILTER (rank = 1) OVER w AS first, max(score) FILTER (rank = 5) OVER w AS fifth FROM bm WINDOW w AS (PARTITION BY query_id)), l AS (SELECT query_id, doc_id, score, rank FROM f WHERE NOT coalesce((first - fifth) / nullif(first, 0) > 0.5, false) OR rank <= 10),
    w AS (SELECT *, count(*) OVER q AS n, max(score) OVER q AS a, coalesce(max(score) FILTER (rank = 2) OVER q, 0) AS b FROM l WINDOW q AS (PARTITION BY query_id))
    SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, CASE WHEN n = 1 THEN 'single' WHEN a >= 0.95 AND a - b >= 0.3 THEN 'early' ELSE 'semantic' END AS route FROM w QUALIFY rank <= 5""",
)
def retrieve_and_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return R.rerank(R.dynamic_limit(R.bm25_topk(docs, _questions(spark, sf_dir), 25), ["query_id"]), None, 5).select("query_id", "doc_id", "score", "rank", "route")


@add(
    "g3_grade",
    f"""WITH {_OWN}, c AS (SELECT query_id, list(DISTINCT u) AS t FROM (SELECT query_id, unnest({TOKENS_SQL}) AS u FROM bm JOIN documents USING (doc_id) WHERE rank <= 3) GROUP BY query_id), a AS (SELECT item_id AS query_id, {TOKENS_SQL} AS q FROM ({_ASKED}))
    SELECT query_id, t IS NOT NULL AND len(q) > 0 AND len(list_intersect(q, t))::DOUBLE / len(q) >= 0.3 AS relevant FROM a LEFT JOIN c USING (query_id)""",
)
def grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = _questions(spark, sf_dir).withColumnRenamed("text", "question")
    return P.coverage_judge(rows.join(_context(docs, rows.withColumnRenamed("question", "text"), 3), "query_id", "left")).select("query_id", "relevant")


@add(
    "g4_rewrite",
    f"""WITH t AS (SELECT item_id, text, {TOKENS_SQL} AS t FROM benchmark), u AS (SELECT item_id, unnest(t) AS w FROM t), r AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) AS k FROM u), j AS (SELECT item_id, string_agg(w, ' ' ORDER BY k) AS q FROM r WHERE k <= 5 GROUP BY item_id)
    SELECT item_id, coalesce(q, text) AS query FROM t LEFT JOIN j USING (item_id)""",
)
def rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", P.keyword_rewrite(F.col("text")).alias("query"))


def _extracted(source: str) -> str:
    """CTEs on top of a table (k, question, context): x (k, answer), two sentences with most of the question's terms."""
    return f"""xs AS (SELECT k, question, list_filter(string_split(regexp_replace(context, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p) <> '') AS l FROM {source} WHERE context IS NOT NULL),
    xr AS (SELECT k, question, unnest(l) AS text, unnest(range(len(l))) AS i FROM xs), xn AS (SELECT k, text, i, len(list_intersect({TOKENS_SQL.replace('text', 'question')}, {TOKENS_SQL})) AS n FROM xr),
    xk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, i) AS r FROM xn), x AS (SELECT k, string_agg(text, ' ' ORDER BY r) AS answer FROM xk WHERE r <= 2 GROUP BY k)"""


@add(
    "g5_generate",
    f"""WITH src AS (SELECT a.conv_id || ':' || a.turn AS k, a.conv_id, a.turn, u.text AS question, a.text AS context FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user'),
    {_extracted('src')} SELECT conv_id, turn, coalesce(answer, '') AS answer FROM src LEFT JOIN x USING (k)""",
)
def generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    return turns.where("role = 'assistant'").select("conv_id", "turn", "text").join(asked, ["conv_id", "turn"]).select("conv_id", "turn", P.extractive_answer(F.col("q"), F.col("text")).alias("answer"))


_SECOND = _BM25[_BM25.index("b0 AS") :].replace("b0", "b9").replace("bm AS", "bm2 AS").replace("FROM q JOIN", "FROM q2 JOIN")


@add(
    "g6_workflow",
    f"""WITH {_OWN}, a AS (SELECT item_id AS query_id, text AS question, {TOKENS_SQL} AS qt, CASE WHEN length(text) < 10 AND ({_GREETS.replace('lower(q)', 'lower(text)')}) THEN 'general' ELSE 'rag' END AS route FROM ({_ASKED})),
    c AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, list_distinct(flatten(list({TOKENS_SQL}))) AS t FROM bm JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id),
    j AS (SELECT a.*, context, context IS NOT NULL AND len(qt) > 0 AND len(list_intersect(qt, t))::DOUBLE / len(qt) >= 0.3 AS relevant FROM a LEFT JOIN c USING (query_id) WHERE route = 'rag'),
    rw AS (SELECT query_id, question, unnest(qt) AS w FROM j WHERE NOT relevant), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(w) DESC, w) AS k FROM rw), r AS (SELECT query_id, string_agg(w, ' ' ORDER BY k) AS text FROM rk WHERE k <= 5 GROUP BY query_id),
    q2 AS (SELECT query_id, unnest({TOKENS_SQL}) AS term FROM r), {_SECOND},
    c2 AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM bm2 JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id),
    src AS (SELECT query_id AS k, question, context, 0 AS retries FROM j WHERE relevant UNION ALL SELECT r.query_id, r.text, c2.context, 1 FROM r LEFT JOIN c2 USING (query_id)), {_extracted('src')}
    SELECT query_id, 'general' AS route, 0 AS retries, question AS query, 'Hello! Ask me about the documents.' AS answer FROM a WHERE route = 'general' UNION ALL SELECT k, 'generate', retries, question, coalesce(answer, '') FROM src LEFT JOIN x USING (k)""",
)
def workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(table(spark, sf_dir, "documents").select("doc_id", "text"), _questions(spark, sf_dir))


@add(
    "g7_state_reducers",
    "SELECT conv_id, CAST(count(*) - 1 AS BIGINT) AS retry_count, array_to_string(list(role ORDER BY turn), ',') AS search_queries FROM conversations GROUP BY conv_id",
)
def state_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    old = turns.groupBy("conv_id").agg(F.array(F.min_by("role", "turn")).alias("search_queries"), F.lit(0).cast("bigint").alias("retry_count"))
    rest = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("l")).select("conv_id", F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x: x["role"]).alias("search_queries"), (F.size("l") - 1).cast("bigint").alias("retry_count"))
    return merge_state(old, rest, "conv_id").select("conv_id", F.array_join("search_queries", ",").alias("search_queries"), "retry_count")
