"""Aggregations, series statistics, anomalies, alerts and reports over the events (inventory A), and predicates (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.routing import EXACT_PATTERNS, GREETINGS, MEANING_WORDS, intent, sparse_weight
from ..sources.tables import table
from .registry import REGISTRY, shared

add = REGISTRY.add
BY_TYPE = ["event_type"]
TIES = ["event_id"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


_SORTED = "SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events"


@add(
    "a1_series_stats",
    f"""WITH s AS ({_SORTED}) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS stdev, min(value) AS lo, max(value) AS hi,
    max(value) FILTER (i = n // 4) AS p25, max(value) FILTER (i = 3 * n // 4) AS p75 FROM s GROUP BY event_type""",
)
def series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    plain = e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("stdev"), F.min("value").alias("lo"), F.max("value").alias("hi"),
    )
    picks = M.rank_pick(e, BY_TYPE, "value", {"p25": F.expr("n div 4"), "p75": F.expr("3 * n div 4")}, TIES)
    return plain.join(picks, "event_type").join(M.medians(e, BY_TYPE, "value").select("event_type", F.round("median", 6).alias("median")), "event_type")


@add(
    "a2_trend",
    """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events), r AS (SELECT event_type, regr_slope(value, i) AS b FROM s GROUP BY event_type)
    SELECT event_type, round(b, 6) AS slope, CASE WHEN b > 0.05 THEN 'increasing' WHEN b < -0.05 THEN 'decreasing' ELSE 'stable' END AS trend FROM r""",
)
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.trend(_events(spark, sf_dir), BY_TYPE, "value", ["ts", "event_id"])


@add(
    "a3_volatility",
    """WITH s AS (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events)
    SELECT event_type, round(coalesce(stddev_samp(CASE WHEN b = 0 THEN 0 ELSE (value - b) / b END), 0), 6) AS volatility FROM s WHERE b IS NOT NULL GROUP BY event_type""",
)
def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.volatility(_events(spark, sf_dir), BY_TYPE, "value", ["ts", "event_id"])


def _picks(rule: str) -> dict:
    return {name: M.percentile_place(p, rule) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}


def _picks_sql(place: str) -> str:
    return f"WITH s AS ({_SORTED}) SELECT event_type, " + ", ".join(f"max(value) FILTER (i = {place.format(p=p)}) AS {n}" for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM s GROUP BY event_type"


@add("a4_percentiles_inclusive", _picks_sql("CAST(floor((n - 1) * CAST({p} AS DOUBLE)) AS BIGINT)"))
def percentiles_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rank_pick(_events(spark, sf_dir), BY_TYPE, "value", _picks("n1"), TIES)


@add(
    "a5_operation_stats",
    f"""WITH s AS ({_SORTED}), p AS (SELECT event_type, max(value) FILTER (i = least(CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT), n - 1)) AS p95 FROM s GROUP BY event_type)
    SELECT e.event_type, count(*) AS total, count(*) FILTER (value > 50) AS failed, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, CAST(sum(length(props)) FILTER (length(props) > 8) AS BIGINT) AS tokens, any_value(p95) AS p95
    FROM events e JOIN p USING (event_type) GROUP BY e.event_type""",
)
def operation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    size = F.length("props").cast("bigint")
    plain = e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 50).alias("failed"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.round(F.avg("value"), 6).alias("mean"), F.sum(F.when(size > 8, size)).alias("tokens"),
    )
    return plain.join(M.rank_pick(e, BY_TYPE, "value", {"p95": M.percentile_place(0.95, "clamped")}, TIES), "event_type")


@add("a6_percentiles_raw", _picks_sql("CAST(floor(n * CAST({p} AS DOUBLE)) AS BIGINT)"))
def percentiles_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rank_pick(_events(spark, sf_dir), BY_TYPE, "value", _picks("raw"), TIES)


@add(
    "a7_component_summary",
    f"""WITH s AS ({_SORTED}) SELECT event_type, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS stdev, max(value) FILTER (i = CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT)) AS p95 FROM s GROUP BY event_type""",
)
def component_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    plain = e.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"), F.round(F.stddev_samp("value"), 6).alias("stdev"))
    return plain.join(M.rank_pick(e, BY_TYPE, "value", {"p95": M.percentile_place(0.95, "raw")}, TIES), "event_type")


@add(
    "a8_adaptive_timeout",
    """WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100),
    s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM l)
    SELECT event_type, round(greatest(1.0, 1.2 * max(value) FILTER (i = least(CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT), n - 1))), 6) AS timeout FROM s GROUP BY event_type""",
)
def adaptive_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = M.last_n(_events(spark, sf_dir), BY_TYPE, [F.desc("ts"), F.desc("event_id")], 100)
    picked = M.rank_pick(last, BY_TYPE, "value", {"p95": M.percentile_place(0.95, "clamped")}, TIES)
    return picked.select("event_type", F.round(F.greatest(F.lit(1.0), 1.2 * F.col("p95")), 6).alias("timeout"))


_BEFORE = "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"


@add(
    "a9_anomaly_zscore",
    f"""WITH s AS (SELECT event_id, value, avg(value) {_BEFORE} AS m, stddev_samp(value) {_BEFORE} AS d FROM events), z AS (SELECT event_id, (value - m) / d AS z FROM s WHERE d > 0)
    SELECT event_id, round(z, 6) AS z, CASE WHEN z > 0 THEN 'spike' ELSE 'dip' END AS kind, round(least(1.0, abs(z) / 4.0), 6) AS confidence FROM z WHERE abs(z) > 2""",
)
def anomaly_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.zscore_anomalies(_events(spark, sf_dir), BY_TYPE, "value", ["ts", "event_id"], 50)
    return found.select("event_id", F.round("z", 6).alias("z"), "kind", F.round("confidence", 6).alias("confidence"))


@add(
    "a10_anomaly_iqr",
    f"""WITH s AS (SELECT event_id, value, list_sort(list(value) {_BEFORE}) AS h FROM events), q AS (SELECT event_id, value, h[len(h) // 4 + 1] AS q1, h[3 * len(h) // 4 + 1] AS q3 FROM s WHERE len(h) >= 4)
    SELECT event_id, q1, q3, CASE WHEN value > q3 THEN 'spike' ELSE 'dip' END AS kind FROM q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def anomaly_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.iqr_anomalies(_events(spark, sf_dir), BY_TYPE, "value", ["ts", "event_id"], 50).select("event_id", "q1", "q3", "kind")


@add(
    "a11_anomaly_mad",
    """WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY event_type), o AS (SELECT e.*, med, abs(value - med) AS dev FROM events e JOIN m USING (event_type)), d AS (SELECT event_type, median(dev) AS mad FROM o GROUP BY event_type)
    SELECT event_id, round(0.6745 * (value - med) / mad, 6) AS score FROM o JOIN d USING (event_type) WHERE mad > 0 AND abs(0.6745 * (value - med) / mad) > 2""",
)
def anomaly_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mad_anomalies(_events(spark, sf_dir), BY_TYPE, "value").select("event_id", F.round("score", 6).alias("score"))


_SEVERITY = "CASE WHEN value > 100 THEN 'critical' WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'medium' ELSE 'low' END"
shared("a12_alert_summary", f"SELECT {_SEVERITY} AS severity, count(*) AS n FROM {{events}} GROUP BY {_SEVERITY}")


@add(
    "a13_cluster_stats",
    """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdev, round(coalesce(regr_slope(value, i), 0), 6) AS slope FROM s GROUP BY user_id""",
)
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    plain = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("stdev"))
    return plain.join(M.trend(e, ["user_id"], "value", ["ts", "event_id"]).select("user_id", "slope"), "user_id")


_LIMITS = "(VALUES ('click', 50.0), ('view', 80.0), ('purchase', 20.0), ('error', 5.0), ('signup', 60.0))"
shared(
    "a14_bottlenecks",
    f"""SELECT event_id, CASE WHEN value > 2 * lim THEN 'critical' WHEN value > 1.5 * lim THEN 'high' ELSE 'medium' END AS severity, CASE WHEN event_type = 'error' THEN 'error_rate' ELSE 'slow_query' END AS kind
    FROM {{events}} JOIN (SELECT * FROM {_LIMITS} AS t(kind_of, lim)) l ON event_type = kind_of WHERE value > lim""",
)
shared(
    "a15_system_health",
    f"""SELECT user_id, CASE WHEN sum(CASE WHEN s = 'critical' THEN 1 ELSE 0 END) > 0 THEN 'critical' WHEN sum(CASE WHEN s = 'high' THEN 1 ELSE 0 END) > 2 THEN 'degraded' ELSE 'healthy' END AS health
    FROM (SELECT user_id, {_SEVERITY} AS s FROM {{events}}) x GROUP BY user_id""",
)
_HALVES = """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY {order}) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    h AS (SELECT event_type, avg(value) FILTER (i <= n // 2) AS a, avg(value) FILTER (i > n // 2) AS b FROM s GROUP BY event_type)
    SELECT event_type, round(a, 6) AS first_half, round(b, 6) AS second_half, CASE WHEN b > a THEN 'degrading' ELSE 'improving' END AS trend FROM h"""


@add("a16_half_period_trend", _HALVES.format(order="ts, event_id"))
def half_period_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.half_trend(_events(spark, sf_dir), BY_TYPE, "value", ["ts", "event_id"])


@add("a16_half_period_trend_faithful", _HALVES.format(order="value, ts, event_id"))
def half_period_trend_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.half_trend(_events(spark, sf_dir), BY_TYPE, "value", ["ts", "event_id"], faithful=True)


shared("a17_counts_by_type_and_severity", f"SELECT event_type, {_SEVERITY} AS severity, count(*) AS n FROM {{events}} GROUP BY event_type, {_SEVERITY}")
shared(
    "a18_memory_stats",
    "SELECT user_id, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, max_by(value, struct(ts, event_id)) AS latest FROM {events} GROUP BY user_id",
    "SELECT user_id, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, max_by(value, row(ts, event_id)) AS latest FROM events GROUP BY user_id",
)
_NODE = "CASE WHEN s_acctbal < 0 THEN 'offline' WHEN s_acctbal < 4000 THEN 'busy' ELSE 'idle' END"
shared("a19_cluster_status", f"SELECT {_NODE} AS status, count(*) AS nodes, round(avg(s_acctbal), 6) AS mean_load FROM {{supplier}} GROUP BY {_NODE}")
shared(
    "a20_peak_and_average",
    """SELECT user_id, max(value) AS peak, round(avg(CASE WHEN k <= 1000 THEN value END), 6) AS recent FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {events}) x GROUP BY user_id""",
)
shared(
    "a21_health_from_metrics",
    """SELECT user_id, CASE WHEN peak > 1000 AND share > 0.1 THEN 'memory,errors' WHEN peak > 1000 THEN 'memory' WHEN share > 0.1 THEN 'errors' ELSE '' END AS issues
    FROM (SELECT user_id, max(value) * 10 AS peak, avg(CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS share FROM {events} GROUP BY user_id) x""",
)
shared(
    "a22_report",
    "SELECT event_type, user_id, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 3) AS mean, min(ts) AS first_seen, max(ts) AS last_seen FROM {events} GROUP BY event_type, user_id",
)
_FAILS = "SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS bad, count(*) AS n FROM {events} GROUP BY user_id"
_STATUS = "CASE WHEN bad = n THEN 'unhealthy' WHEN bad > 0 THEN 'degraded' ELSE 'healthy' END"
shared("a23_node_health", f"SELECT user_id, {_STATUS} AS status FROM ({_FAILS}) x")
shared("a24_cluster_health", f"SELECT CASE max(CASE WHEN bad = n THEN 2 WHEN bad > 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status, count(*) AS nodes FROM ({_FAILS}) x")
shared(
    "a25_cache_statistics",
    "SELECT event_type, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN value > 10 THEN 0 ELSE 1 END) AS misses, round(avg(CASE WHEN value > 10 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS rate FROM {events} GROUP BY event_type",
    "SELECT event_type, CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN value > 10 THEN 0 ELSE 1 END) AS BIGINT) AS misses, round(avg(CASE WHEN value > 10 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS rate FROM events GROUP BY event_type",
)
shared(
    "a26_deployment_stats",
    "SELECT o_orderpriority AS service, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS success_rate, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 6) AS mean_duration FROM {orders} GROUP BY o_orderpriority",
)
shared(
    "a27_migration_stats",
    "SELECT o_orderstatus AS status, o_orderpriority AS kind, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM {orders} GROUP BY o_orderstatus, o_orderpriority",
    "SELECT o_orderstatus AS status, o_orderpriority AS kind, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders GROUP BY o_orderstatus, o_orderpriority",
)
shared(
    "a28_access_stats",
    "SELECT user_id, count(*) AS total, count(CASE WHEN event_type <> 'error' THEN 1 END) AS allowed, count(CASE WHEN event_type = 'error' THEN 1 END) AS denied, round(count(CASE WHEN event_type = 'error' THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS denial_rate FROM {events} GROUP BY user_id",
)
shared("a29_circuit_rates", "SELECT event_type, round(count(CASE WHEN value > 50 THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS failure_rate, round(count(CASE WHEN value <= 50 THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS success_rate FROM {events} GROUP BY event_type")
shared("a30_degradation_level", "SELECT s_nationkey, CASE WHEN share = 0 THEN 0 WHEN share < 0.5 THEN 1 ELSE 2 END AS level FROM (SELECT s_nationkey, avg(CASE WHEN s_acctbal < 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS share FROM {supplier} GROUP BY s_nationkey) x")
shared("a31_session_stats", "SELECT count(DISTINCT conv_id) AS sessions, count(*) AS messages FROM {conversations}")
shared("a32_connection_stats", "SELECT event_type AS channel, count(DISTINCT user_id) AS clients, count(*) AS messages FROM {events} GROUP BY event_type")


@add(
    "a33_benchmark_stats",
    """WITH s AS (SELECT event_type, list_sort(list(value)) AS l FROM events GROUP BY event_type), p AS (SELECT event_type, l, len(l) AS n, (len(l) + 1) * 19 // 20 AS j, (len(l) + 1) * 19 % 20 AS r FROM s)
    SELECT event_type, round(list_sum(l), 4) AS total, round(list_avg(l), 6) AS mean, l[1] AS lo, l[n] AS hi, round((l[j] * (20 - r) + l[j + 1] * r) / 20, 6) AS p95, round(n / list_sum(l), 6) AS throughput FROM p""",
)
def benchmark_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    plain = e.groupBy("event_type").agg(F.sum("value").alias("t"), F.avg("value").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("c"))
    j = F.expr("(n + 1) * 19 div 20")
    picked = M.rank_pick(e, BY_TYPE, "value", {"a": j - 1, "b": j}, TIES)
    r = (F.col("c") + 1) * 19 % 20
    return plain.join(picked, "event_type").select(
        "event_type", F.round("t", 4).alias("total"), F.round("m", 6).alias("mean"), "lo", "hi",
        F.round((F.col("a") * (20 - r) + F.col("b") * r) / 20, 6).alias("p95"), F.round(F.col("c") / F.col("t"), 6).alias("throughput"),
    )


shared("a34_word_totals", r"SELECT source, sum(size(filter(split(text, '[ \t\n\r]+'), w -> w <> ''))) AS words FROM {documents} GROUP BY source", r"SELECT source, CAST(sum(len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> ''))) AS BIGINT) AS words FROM documents GROUP BY source")

# predicates and projections
_ASKED = "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Hello ' || item_id WHEN 1 THEN '누구' || item_id % 7 WHEN 2 THEN left(text, 9) ELSE 'hello, ' || text END AS q FROM benchmark"


@add("p1_query_intent", f"SELECT item_id, CASE WHEN length(q) < 10 AND ({' OR '.join(f"contains(lower(q), '{g}')" for g in GREETINGS)}) THEN 'general' ELSE 'rag' END AS intent FROM ({_ASKED})")
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text, i = F.col("item_id") % 4, F.col("text"), F.col("item_id")
    q = F.when(k == 0, F.concat(F.lit("Hello "), i)).when(k == 1, F.concat(F.lit("누구"), i % 7)).when(k == 2, F.left(text, F.lit(9))).otherwise(F.concat(F.lit("hello, "), text))
    return table(spark, sf_dir, "benchmark").select("item_id", intent(q).alias("intent"))


_EXACT, _MEANING = " OR ".join(f"regexp_matches(q, '{p}')" for p in EXACT_PATTERNS), " OR ".join(f"contains(q, '{w}')" for w in MEANING_WORDS)


@add(
    "p2_dynamic_weights",
    f"""WITH x AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'release v1.2 ' || text WHEN 1 THEN '차이 ' || text WHEN 2 THEN '비교 0x1f ' || text ELSE text END AS q FROM benchmark), f AS (SELECT item_id, {_EXACT} AS e, {_MEANING} AS m FROM x)
    SELECT item_id, CAST(CASE WHEN e AND NOT m THEN 0.8 WHEN m AND NOT e THEN 0.2 ELSE 0.4 END AS DOUBLE) AS sparse_weight FROM f""",
)
def dynamic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("item_id") % 4, F.col("text")
    q = F.concat(F.when(k == 0, F.lit("release v1.2 ")).when(k == 1, F.lit("차이 ")).when(k == 2, F.lit("비교 0x1f ")).otherwise(F.lit("")), text)
    return table(spark, sf_dir, "benchmark").select("item_id", sparse_weight(q).alias("sparse_weight"))


shared(
    "p3_noise_and_reference_flags",
    r"""SELECT doc_id, noise, max(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) = 1 AS is_reference FROM (
    SELECT doc_id, source, regexp_like(lower(substr(text, 1, 100)), 'copyright|license|arxiv') OR length(text) - length(replace(text, ',', '')) > 25 AS noise, regexp_like(lower(text), '(^|\\n)(the )?(references|licensed)') AS heading FROM {documents}) x""",
    r"""SELECT doc_id, noise, max(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) = 1 AS is_reference FROM (
    SELECT doc_id, source, regexp_matches(lower(substr(text, 1, 100)), 'copyright|license|arxiv') OR length(text) - length(replace(text, ',', '')) > 25 AS noise, regexp_matches(lower(text), '(^|\n)(the )?(references|licensed)') AS heading FROM documents) x""",
)
shared("p4_needs_subchunking", "SELECT source, bool_or(length(text) > 1.5 * 5000) AS needs FROM {documents} GROUP BY source")
shared("p5_event_query", "SELECT event_id, ts FROM {events} WHERE event_type IN ('error', 'purchase') AND value > 20 AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 100")
shared("p6_user_activity", "SELECT user_id, event_id, k FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {events}) x WHERE k <= 100", "SELECT user_id, event_id, k FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS k FROM events) x WHERE k <= 100")
shared("p7_score_threshold", "SELECT event_id, value FROM {events} WHERE value >= 25.0")
shared(
    "p8_access_check",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'locked' WHEN a.role_key IS NULL THEN 'no role' WHEN a.admin = 1 OR a.wanted = c_mktsegment THEN 'allowed' ELSE 'denied' END AS verdict
    FROM {customer} LEFT JOIN (SELECT n_nationkey AS role_key, CASE WHEN n_regionkey = 0 THEN 1 ELSE 0 END AS admin, CASE n_regionkey WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'MACHINERY' WHEN 3 THEN 'FURNITURE' ELSE 'AUTOMOBILE' END AS wanted FROM {nation}) a ON c_nationkey = a.role_key""",
)
shared("p9_metadata_lookup", "SELECT 'lang' AS field, lang AS val, count(*) AS n, min(doc_id) AS first_id FROM {documents} GROUP BY lang UNION ALL SELECT 'source', source, count(*), min(doc_id) FROM {documents} GROUP BY source")
shared("p10_access_log_filter", "SELECT event_id FROM {events} WHERE event_type <> 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
shared(
    "p11_lockout",
    "SELECT event_id, n >= 3 AS locked FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM {events} WHERE event_type = 'error') x",
)
shared("p12_healthy_nodes", "SELECT s_suppkey FROM {supplier} WHERE abs(s_acctbal) / 100 < 80 AND s_suppkey % 100 < 85")


_RULES = [(1, "click", ">", 90.0), (2, "view", "<=", 1.0), (3, "error", "==", 50.0), (4, "purchase", "!=", 10.0), (5, "signup", ">=", 99.0), (6, "error", "<", 2.0)]


@add(
    "j11_alert_rules",
    """SELECT rule, event_id FROM events JOIN (VALUES (1, 'click', '>', 90.0), (2, 'view', '<=', 1.0), (3, 'error', '==', 50.0), (4, 'purchase', '!=', 10.0), (5, 'signup', '>=', 99.0), (6, 'error', '<', 2.0)) r(rule, metric, op, lim) ON event_type = metric
    WHERE CASE op WHEN '>' THEN value > lim WHEN '<' THEN value < lim WHEN '>=' THEN value >= lim WHEN '<=' THEN value <= lim WHEN '==' THEN abs(value - lim) < 1e-4 ELSE abs(value - lim) >= 1e-4 END""",
)
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "rule int, metric string, op string, lim double")
    joined = _events(spark, sf_dir).join(F.broadcast(rules), F.col("event_type") == F.col("metric"))  # six rows
    return joined.where(M.condition(F.col("value"), F.col("op"), F.col("lim"))).select("rule", "event_id")


@add("p13_alert_condition", "SELECT event_id, value > 50 AS above, value <= 50 AS upto, abs(value - 50) < 1e-4 AS near FROM events")
def alert_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = lambda op: M.condition(F.col("value"), F.lit(op), F.lit(50.0))
    return _events(spark, sf_dir).select("event_id", test(">").alias("above"), test("<=").alias("upto"), test("==").alias("near"))


shared("p14_config_ranges", "SELECT p_partkey FROM {part} WHERE NOT (p_size BETWEEN 1 AND 40 AND p_retailprice > 0 AND p_size < p_retailprice)")
shared("p15_vector_validation", "SELECT label, count(*) AS n, count(CASE WHEN size(embedding) <> 64 THEN 1 END) AS bad FROM {embeddings} GROUP BY label", "SELECT label, count(*) AS n, count(CASE WHEN len(embedding) <> 64 THEN 1 END) AS bad FROM embeddings GROUP BY label")
shared("p16_checkpoint_filter", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
shared("p17_pending_migrations", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
shared("p17_pending_since", "SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_linenumber >= 3)")
shared("p18_aggregation_validity", "SELECT label, count(*) - count(DISTINCT vec_id) AS duplicates, min(vec_id) AS lo, max(vec_id) AS hi, round(avg(vec_id), 6) AS mean FROM {embeddings} GROUP BY label")
