"""Batch twins of the stateful operators (inventory ST) over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import stateful as X
from ..streaming import typed
from .registry import REGISTRY, shared

add = REGISTRY.add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("sec", F.expr("unix_micros(cast(ts as timestamp)) / 1e6"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the assistant's turns as a token stream, 20 ms apart."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    words = said.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "token"))
    return words.select("conv_id", (F.col("turn") * 100000 + F.col("i")).alias("seq"), "token", ((F.col("turn") * 100000 + F.col("i")) * 20.0).alias("ms"))


@add("st1_token_buffer")
def token_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.replay(_tokens(spark, sf_dir), "conv_id", ["seq"], ["token", "ms"], X.TokenBuffer, "chunk").where("chunk is not null")


@add(
    "st2_adaptive_buffer_size",
    """WITH m AS (SELECT user_id, event_id, row_number() OVER w AS i, avg(value * 10) OVER (w ROWS 49 PRECEDING) AS m, count(*) OVER (w ROWS 49 PRECEDING) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    d AS (SELECT *, CASE WHEN n < 10 THEN 0 WHEN m > 300 THEN 2 WHEN m < 100 THEN -1 ELSE 0 END AS d FROM m), l AS (SELECT user_id, event_id, list(d) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS l FROM d)
    SELECT user_id, event_id, CAST(list_reduce(list_concat([1], l), lambda a, x: greatest(1, least(10, a + x))) AS INTEGER) AS size FROM l""",
)
def adaptive_buffer_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("latency", F.col("value") * 10)
    return X.replay(e, "user_id", ["ts", "event_id"], ["latency"], X.AdaptiveSize, "size").select("user_id", "event_id", F.col("size").cast("int").alias("size"))


shared(
    "st2_latency_mean",
    "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS mean FROM {events}",
)
shared(
    "st3_graph_event_rows",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'custom' WHEN 'view' THEN 'messages' ELSE 'updates' END AS mode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS chunk_index FROM {events}",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'custom' WHEN 'view' THEN 'messages' ELSE 'updates' END AS mode, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS chunk_index FROM events",
)
def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as typed events: notices of questions, thoughts and words of answers 20 ms apart, and a figure after each."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), (F.col("turn") * 100_000).cast("bigint").alias("seq"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = turns.where("role = 'assistant'")
    words = said.select("session", (F.col("seq") + 2).alias("seq"), F.posexplode(F.split("text", " ")).alias("i", "content")).withColumn("seq", F.col("seq") + F.col("i"))
    thoughts = said.where("turn % 4 = 1").select("session", (F.col("seq") + 1).alias("seq"), F.substring("text", 1, 10).alias("thought"))
    timed = lambda df: df.withColumn("at_ms", F.col("seq") * 20.0)
    asked = typed.typed(custom=timed(turns.where("role = 'user'").withColumn("status", F.lit("asked"))), updates=timed(said.select("session", (F.col("seq") + 99_999).alias("seq"), F.lit("{}").alias("performance"))))
    return asked.unionByName(typed.typed(messages=timed(words))).unionByName(typed.typed(messages=timed(thoughts)))


_TYPED = """t AS (SELECT conv_id AS session, turn, role, coalesce(text, '') AS text FROM conversations), w AS (SELECT session, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM t WHERE role = 'assistant'), n AS (SELECT session, sum(n) AS n FROM w GROUP BY session),
    k AS (SELECT session, 'status' AS kind FROM t WHERE role = 'user' UNION ALL SELECT session, 'performance' FROM t WHERE role = 'assistant' UNION ALL SELECT session, 'thought' FROM t WHERE role = 'assistant' AND turn % 4 = 1 AND text <> ''
    UNION ALL SELECT session, unnest(list_transform(range(1 + CAST((n - 1) // 10 AS BIGINT)), lambda i: 'content')) FROM n WHERE n > 0 UNION ALL SELECT session, 'final' FROM n WHERE n > 0 AND (n - 1) % 10 > 0)"""


@add("st3_typed_stream", f"WITH {_TYPED} SELECT session, kind, count(*) AS chunks FROM k GROUP BY session, kind")
def typed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by kind of each session's typed events, the words ten at a time; their numbers have no gap."""
    chunks = typed.replay(_typed(spark, sf_dir), 10, 1e15)
    whole = chunks.groupBy("session").agg((F.max("chunk_index") + 1 == F.count_distinct("chunk_index")).alias("gapless"))
    return chunks.join(whole.where("gapless"), "session").groupBy("session", "kind").agg(F.count(F.lit(1)).alias("chunks"))


@add(
    "st6_stream_timing",
    """WITH t AS (SELECT conv_id AS session, turn, role, coalesce(text, '') AS text FROM conversations), w AS (SELECT session, turn, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM t WHERE role = 'assistant'),
    e AS (SELECT session, turn * 100000 AS seq, 's' AS k FROM t WHERE role = 'user' UNION ALL SELECT session, turn * 100000 + 99999, 's' FROM t WHERE role = 'assistant' UNION ALL SELECT session, turn * 100000 + 2 + i, CASE WHEN w <> '' THEN 'c' ELSE 's' END FROM w
    UNION ALL SELECT session, turn * 100000 + 1, CASE WHEN text <> '' THEN 't' ELSE 's' END FROM t WHERE role = 'assistant' AND turn % 4 = 1), m AS (SELECT session, min(seq) AS b, max(seq) AS z, min(seq) FILTER (k = 't') AS t, min(seq) FILTER (k = 'c') AS c FROM e GROUP BY session)
    SELECT session, (c - b) * 20.0::DOUBLE AS ttft, CASE WHEN c IS NULL OR t IS NULL THEN 0 ELSE greatest(0, c - t) END * 20.0::DOUBLE AS thinking, (z - c) * 20.0::DOUBLE AS answer, (z - b) * 20.0::DOUBLE AS total FROM m""",
)
def stream_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.timing(_typed(spark, sf_dir))


shared("st4_response_metrics", "SELECT user_id AS stream_id, count(*) AS tokens, min(value) AS lowest, max(value) AS highest, round(avg(length(props)), 6) AS mean_chunk, min_by(value, struct(ts, event_id)) AS first_latency FROM {events} GROUP BY user_id", "SELECT user_id AS stream_id, count(*) AS tokens, min(value) AS lowest, max(value) AS highest, round(avg(length(props)), 6) AS mean_chunk, min_by(value, row(ts, event_id)) AS first_latency FROM events GROUP BY user_id")
@add(
    "st5_bounded_response",
    """WITH l AS (SELECT conv_id, list([length(text)] ORDER BY turn, length(text)) AS l FROM conversations GROUP BY conv_id), h AS (SELECT conv_id, list_reduce(l, lambda a, x: list_concat(CASE WHEN list_sum(a) + x[1] > 600 THEN list_filter(a, lambda v, i: list_sum(a[i:]) <= 480) ELSE a END, x)) AS h FROM l)
    SELECT conv_id, len(h) AS chunks, CAST(list_sum(h) AS BIGINT) AS chars FROM h""",
)
def bounded_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.bounded_response(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 600)


shared(
    "st6_answer_timing",
    """SELECT user_id, min(CASE WHEN event_type <> 'view' THEN ts END) AS first_answer, max(ts) AS last_chunk, sum(CASE WHEN prev = event_type THEN 0 ELSE 1 END) AS chunks
    FROM (SELECT user_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {events}) x GROUP BY user_id""",
    """SELECT user_id, min(CASE WHEN event_type <> 'view' THEN ts END) AS first_answer, max(ts) AS last_chunk, CAST(sum(CASE WHEN prev = event_type THEN 0 ELSE 1 END) AS BIGINT) AS chunks
    FROM (SELECT user_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) x GROUP BY user_id""",
)
_GAPS = """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL '1' HOUR THEN 0 ELSE 1 END AS new FROM {events}),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS events FROM s GROUP BY user_id, session"""
shared("st7_idle_sessions", _GAPS)
shared("st8_history_cap", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM {conversations}) x WHERE k <= 1000")


@add("st9_lru_pool")
def lru_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.replay(_events(spark, sf_dir), "user_id", ["ts", "event_id"], ["event_type", "sec"], lambda: X.LruTtlCache(3, float("inf"))).select("event_id", "outcome")


@add("st10_memory_cache")
def memory_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.replay(_events(spark, sf_dir), "user_id", ["ts", "event_id"], ["props", "sec"], lambda: X.LruTtlCache(50, 86400.0)).select("event_id", "outcome")


@add(
    "st11_semantic_cache",
    """SELECT q.vec_id AS query_id, max_by(c.vec_id, row(round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6), -c.vec_id)) AS cached_id, max(round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6)) AS cosine
    FROM embeddings q JOIN embeddings c ON c.vec_id < q.vec_id WHERE round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) >= 0.3 GROUP BY q.vec_id""",
)
def semantic_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.vectors import nearest_earlier

    return nearest_earlier(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3).select(F.col("b").alias("query_id"), F.col("a").alias("cached_id"), "cosine")


shared(
    "st12_tiered_lookup",
    "SELECT o_orderkey, CASE WHEN c.c_custkey IS NOT NULL THEN 'memory' WHEN s.s_suppkey IS NOT NULL THEN 'disk' ELSE 'miss' END AS tier FROM {orders} LEFT JOIN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000) c ON o_custkey = c.c_custkey LEFT JOIN {supplier} s ON o_custkey = s.s_suppkey",
)


@add("st13_circuit_breaker")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    return X.replay(e, "user_id", ["ts", "event_id"], ["ok", "sec"], lambda: X.CircuitBreaker(failures=2)).select("event_id", "outcome")


shared("st14_retry_backoff", "SELECT p_partkey, least(60.0D, power(2, p_size % 10)) AS exponential, least(60.0D, 1.0D + p_size % 10) AS linear, 1.0D AS fixed FROM {part}", "SELECT p_partkey, least(60.0::DOUBLE, power(2, p_size % 10)) AS exponential, least(60.0::DOUBLE, 1.0::DOUBLE + p_size % 10) AS linear, 1.0::DOUBLE AS fixed FROM part")
shared("st15_heartbeat_expiry", "SELECT user_id, max(ts) < TIMESTAMP '2024-01-30 00:00:00' AS expired FROM {events} GROUP BY user_id")
shared("st16_bounded_event_log", "SELECT event_id FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 100000")
shared("st17_check_history", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM {events}) x WHERE k <= 1000")
shared("st18_retention_purge", "SELECT event_id FROM {events} WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND EXISTS (SELECT 1 FROM {customer} WHERE c_custkey = user_id)")
shared(
    "st19_cache_versions",
    """SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS version
    FROM (SELECT user_id, event_id, event_type, ts, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM {events}) x""",
    """SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version
    FROM (SELECT user_id, event_id, event_type, ts, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM events) x""",
)
shared(
    "st20_display_text",
    "SELECT conv_id, md5(array_join(transform(sort_array(collect_list(struct(turn, text))), x -> x.text), '')) AS text_md5 FROM {conversations} GROUP BY conv_id",
    "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id",
)
