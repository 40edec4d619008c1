"""Joins and rules around an answering service (inventory J, P, ST, D, EV) over the tables, with parameters and SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import rules as X
from ..operators import serving as V
from ..operators.routing import GREETINGS, intent
from ..sources import services, snapshots
from ..sources.tables import spread, table
from .registry import REGISTRY

add = REGISTRY.add


@add(
    "j2_cited_document",
    """SELECT item_id, doc_id FROM (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY CASE WHEN contains(coalesce(d.source, ''), substr(md5(b.text), 1, 1)) THEN 0 ELSE 1 END, d.doc_id) AS k
    FROM benchmark b JOIN documents d ON d.doc_id // 4 = b.item_id) x WHERE k = 1""",
)
def cited_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item cites the page of its number, of four documents, and a section by a letter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 4").alias("page"), F.col("source").alias("section"))
    cited = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").cast("bigint").alias("page"), F.substring(F.md5("text"), 1, 1).alias("section"))
    return V.cite(cited, docs, ["item_id"])


@add(
    "j8_line_boxes",
    """WITH w AS (SELECT l_suppkey AS page, l_quantity::DOUBLE AS x0, l_quantity + l_partkey % 4 AS x1, l_extendedprice::DOUBLE % 400 AS y0, l_extendedprice % 400 + l_linenumber % 3 AS y1 FROM (SELECT l_suppkey, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_linenumber, l_partkey FROM lineitem))
    SELECT page, round_even(y0 / 8, 0) * 8 AS line, min(x0) AS x, round(min(y0), 4) AS y, max(x1) - min(x0) AS width, round(max(y1) - min(y0), 4) AS height, count(*) AS words FROM w GROUP BY page, round_even(y0 / 8, 0) * 8 HAVING max(x1) > min(x0) AND max(y1) > min(y0)""",
)
def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double") % 400
    words = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), x.alias("x0"), (x + F.col("l_partkey") % 4).alias("x1"), y.alias("y0"), (y + F.col("l_linenumber") % 3).alias("y1"))
    return V.lines_of(words).withColumns({"y": F.round("y", 4), "height": F.round("height", 4)})


@add(
    "j12_highlight_hits",
    """WITH p AS (SELECT u.conv_id, u.turn, list_filter(string_split_regex(trim(regexp_replace(u.text, '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 2) AS w, lower(a.text) AS t FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
    s AS (SELECT conv_id, turn, len(w) AS words, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(t, lower(x))))::DOUBLE / len(w) ELSE 0 END AS share FROM p) SELECT conv_id, turn, words, round(share, 6) AS share, share > 0.5 AS hit FROM s""",
)
def highlight_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("_expected"))
    return V.highlight_hits(turns.where("role = 'user'").join(said, ["conv_id", "turn"]), ["conv_id", "turn"], F.col("text"), F.col("_expected")).withColumn("words", F.col("words").cast("bigint"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph-sized chunks; every ninth begins references, every seventh cites much."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "text")
    cut = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 600))).alias("chunk"))
    begin = F.when((F.col("doc_id") + F.col("chunk")) % 9 == 8, "## References ").when((F.col("doc_id") + F.col("chunk")) % 7 == 6, "see a, doi:1 doi:2 doi:3 ").otherwise("")
    return cut.select("doc_id", "chunk", F.concat(begin, F.substring(F.col("text"), (F.col("chunk") * 600 + 1).cast("int"), F.lit(600))).alias("text"))


_TAGGED = """c AS (SELECT doc_id, chunk, lower(CASE WHEN (doc_id + chunk) % 9 = 8 THEN '## References ' WHEN (doc_id + chunk) % 7 = 6 THEN 'see a, doi:1 doi:2 doi:3 ' ELSE '' END || substr(text, chunk * 600 + 1, 600)) AS t FROM (SELECT doc_id, text, unnest(range((length(text) + 599) // 600)) AS chunk FROM documents WHERE length(text) > 0)),
    m AS (SELECT doc_id, chunk, contains(substr(t, 1, 50), '## references') OR contains(substr(t, 1, 50), 'references' || chr(10) || '---') AS b, regexp_matches(substr(t, 1, 100), 'index|references|bibliography|doi:|isbn') OR len(regexp_extract_all(t, 'doi:')) > 2 OR length(t) - length(replace(t, ',', '')) > 25 AS noise FROM c)"""


@add("p3_content_tags", f"WITH {_TAGGED}, r AS (SELECT *, bool_or(b) OVER (PARTITION BY doc_id ORDER BY chunk ROWS UNBOUNDED PRECEDING) AS is_reference FROM m) SELECT doc_id, chunk, is_reference, NOT (noise OR is_reference) AS is_content FROM r")
def content_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tag_content(_chunks(spark, sf_dir), ["doc_id"], "chunk").drop("text")


def _access(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as users with the role of their nation, in which regions grant actions on resources; nation 0 administers."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    users = c.where("c_custkey % 11 <> 0").select(F.col("c_custkey").cast("bigint").alias("user_id"), (F.col("c_acctbal") > -500).alias("is_active"), (F.col("c_custkey") % 13 == 0).alias("is_locked"))
    members = c.select(F.col("c_custkey").cast("bigint").alias("user_id"), F.col("c_nationkey").alias("role"))
    roles = n.select(F.col("n_nationkey").alias("role"), (F.col("n_nationkey") == 0).alias("is_admin"))
    resource_id = F.when(F.col("n_nationkey") % 2 == 0, F.lit(None)).otherwise((F.col("n_nationkey") % 7).cast("string"))
    grants = n.select(F.col("n_nationkey").alias("role"), F.when(F.col("n_regionkey") % 2 == 0, "read").otherwise("write").alias("action"), F.concat(F.lit("r"), (F.col("n_nationkey") % 3).cast("string")).alias("resource"), resource_id.alias("resource_id"))
    return {"users": users, "memberships": members, "roles": roles, "grants": grants}


_RIGHTS = """u AS (SELECT c_custkey AS user_id, c_acctbal > -500 AS is_active, c_custkey % 13 = 0 AS is_locked FROM customer WHERE c_custkey % 11 <> 0), g AS (SELECT n_nationkey AS role, CASE WHEN n_regionkey % 2 = 0 THEN 'read' ELSE 'write' END AS action, 'r' || (n_nationkey % 3) AS resource,
    CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE CAST(n_nationkey % 7 AS VARCHAR) END AS resource_id FROM nation)"""


@add("j9_effective_permissions", f"WITH {_RIGHTS} SELECT DISTINCT CAST(c_custkey AS BIGINT) AS user_id, action, resource, resource_id FROM customer JOIN g ON role = c_nationkey OR c_nationkey = 0")
def effective_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _access(spark, sf_dir)
    return V.permissions(a["memberships"], a["roles"], a["grants"])


@add(
    "p8_access_decisions",
    f"""WITH {_RIGHTS}, q AS (SELECT o_orderkey AS request, o_custkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'read' ELSE 'write' END AS action, 'r' || (o_orderkey % 3) AS resource, CAST(o_orderkey % 7 AS VARCHAR) AS rid FROM orders),
    t AS (SELECT request, u.user_id IS NOT NULL AS known, is_active, is_locked, c_nationkey = 0 OR EXISTS (SELECT 1 FROM g WHERE g.role = c_nationkey AND g.action = q.action AND g.resource = q.resource AND (g.resource_id IS NULL OR g.resource_id = q.rid)) AS may FROM q LEFT JOIN u USING (user_id) LEFT JOIN customer ON c_custkey = q.user_id),
    r AS (SELECT request, CASE WHEN NOT known THEN 'user_not_found' WHEN NOT is_active THEN 'user_inactive' WHEN is_locked THEN 'user_locked' WHEN NOT coalesce(may, false) THEN 'no_permission' END AS reason FROM t) SELECT CAST(request AS BIGINT) AS request, reason IS NULL AS allowed, reason FROM r""",
)
def access_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests of their customers."""
    key = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(key.cast("bigint").alias("request"), F.col("o_custkey").cast("bigint").alias("user_id"), F.when(key % 2 == 0, "read").otherwise("write").alias("action"), F.concat(F.lit("r"), (key % 3).cast("string")).alias("resource"), (key % 7).cast("string").alias("resource_id"))
    return V.check_access(asked, ["request"], **_access(spark, sf_dir))


@add(
    "p11_lockouts_reset",
    """WITH a AS (SELECT event_id, user_id, ts, event_type = 'purchase' AS ok FROM events), e AS (SELECT *, coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, ok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM a),
    f AS (SELECT event_id, CASE WHEN ok THEN 0 ELSE count(*) FILTER (NOT ok) OVER (PARTITION BY user_id, epoch ORDER BY epoch_us(ts) RANGE BETWEEN 259199999999 PRECEDING AND CURRENT ROW) END AS failures FROM e) SELECT event_id, failures, failures >= 4 AS locked FROM f""",
)
def lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts, of which purchases succeed; four failures in three days without one lock."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("ok"))
    return X.lockouts(e, "user_id", "ts", "ok", most=4, seconds=3 * 86400.0).select("event_id", "failures", "locked")


@add("p12_nodes_below", "SELECT s_suppkey FROM supplier WHERE (s_acctbal + 1000) / 110 < 80 AND s_suppkey % 100 < 85")
def healthy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_acctbal") + 1000) / 110).alias("cpu"), (F.col("s_suppkey") % 100).alias("memory"))
    return X.healthy(nodes, {"cpu": 80, "memory": 85}).select("s_suppkey")


@add(
    "p14_settings_outside",
    """WITH s AS (SELECT p_partkey, p_size * 50 AS chunk_size, p_partkey % 700 AS chunk_overlap, p_partkey % 120 AS top_k, p_partkey % 2 = 0 AS bm25, p_partkey % 3 = 0 AS semantic FROM part)
    SELECT p_partkey, 'chunk_size not in 100..2000' AS rule FROM s WHERE NOT chunk_size BETWEEN 100 AND 2000 UNION ALL SELECT p_partkey, 'chunk_overlap not in 0..500' FROM s WHERE NOT chunk_overlap BETWEEN 0 AND 500
    UNION ALL SELECT p_partkey, 'top_k not in 1..100' FROM s WHERE NOT top_k BETWEEN 1 AND 100 UNION ALL SELECT p_partkey, 'overlap reaches the size' FROM s WHERE chunk_overlap >= chunk_size UNION ALL SELECT p_partkey, 'no retriever' FROM s WHERE NOT (bm25 OR semantic)""",
)
def setting_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    settings = table(spark, sf_dir, "part").select(k, (F.col("p_size") * 50).alias("chunk_size"), (k % 700).alias("chunk_overlap"), (k % 120).alias("top_k"), (k % 2 == 0).alias("bm25"), (k % 3 == 0).alias("semantic"))
    ranges = {"chunk_size": (100, 2000), "chunk_overlap": (0, 500), "top_k": (1, 100)}
    return X.violations(settings, "p_partkey", ranges, {"overlap reaches the size": F.col("chunk_overlap") >= F.col("chunk_size"), "no retriever": ~(F.col("bm25") | F.col("semantic"))})


@add("p4_split_needed", "SELECT doc_id, CAST(max(length(l)) AS INTEGER) AS longest, max(length(l)) > 300 AS needs_split FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents) GROUP BY doc_id")
def needs_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks of a size of 200."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("l"))
    return X.needs_split(lines, ["doc_id"], "l", 200)


@add(
    "c22_clipped",
    """SELECT conv_id, turn, CASE WHEN contains(text, '. ') THEN md5(array_to_string(list_filter(string_split(text, '. '), lambda p: trim(p) <> '')[1:3], '~')) ELSE md5(substr(text, 1, 40)) END AS clip_md5 FROM conversations""",
)
def clipped_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sentences of a turn, or 40 characters of one without."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.array_join(X.clipped(F.col("text"), ". ", 3, 40), "~")).alias("clip_md5"))


@add("j10_channel_messages", "SELECT CAST(e.event_id AS BIGINT) AS message_id, CAST(s.s_suppkey AS BIGINT) AS client_id FROM events e JOIN supplier s ON s.s_nationkey = e.user_id % 25 WHERE e.event_type = 'click' AND s.s_suppkey <> e.user_id")
def channel_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").cast("bigint").alias("message_id"), (F.col("user_id") % 25).cast("int").alias("channel"), F.col("user_id").cast("bigint").alias("sender"))
    held = table(spark, sf_dir, "supplier").where("s_suppkey is not null").select(F.col("s_suppkey").cast("bigint").alias("client_id"), F.col("s_nationkey").cast("int").alias("channel"))
    return V.broadcast_messages(sent, held)


@add(
    "st12_tiered_values",
    """WITH q AS (SELECT o_orderkey AS k, o_custkey AS key, o_orderkey % 3 = 0 AS m FROM orders), t AS (SELECT DISTINCT key, m FROM q),
    r AS (SELECT t.key, m, CASE WHEN NOT m AND c.c_custkey IS NOT NULL THEN 'memory' WHEN m AND t.key % 5 = 0 THEN 'semantic' WHEN NOT m AND s.s_suppkey IS NOT NULL THEN 'disk' ELSE 'miss' END AS tier, c.c_name AS cn, s.s_name AS sn FROM t LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON c.c_custkey = t.key LEFT JOIN supplier s ON s.s_suppkey = t.key)
    SELECT CAST(key AS BIGINT) AS key, m AS by_meaning, CASE tier WHEN 'memory' THEN cn WHEN 'semantic' THEN 'like ' || key WHEN 'disk' THEN sn END AS value, tier, tier IN ('semantic', 'disk') AS promote FROM r""",
)
def tiered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of orders, asked as they are or by meaning, against customers (memory) and suppliers (disk)."""
    key = lambda c: F.col(c).cast("bigint").alias("key")
    orders, c, s = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    asked = orders.select(key("o_custkey"), (F.col("o_orderkey") % 3 == 0).alias("by_meaning")).distinct()
    similar = asked.where("key % 5 = 0").select("key", F.concat(F.lit("like "), F.col("key").cast("string")).alias("value")).distinct()
    return V.tiered_lookup(asked, c.where("c_acctbal > 5000").select(key("c_custkey"), F.col("c_name").alias("value")), similar, s.select(key("s_suppkey"), F.col("s_name").alias("value")))


@add("st14_retry_delays", "SELECT p_partkey, least(60, power(2, p_size % 10))::DOUBLE AS exponential, least(60, 1 + p_size % 10)::DOUBLE AS linear, 1.0::DOUBLE AS fixed, true AS jitter_in_bounds FROM part")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = (F.col("p_size") % 10).cast("int")
    plain = {s: V.retry_delay(attempt, s).cast("double") for s in ("exponential", "linear", "fixed")}
    jitter = V.retry_delay(attempt, "exponential", jitter_of=F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in plain.items()], ((jitter >= plain["exponential"]) & (jitter <= 1.1 * plain["exponential"])).alias("jitter_in_bounds"))


@add(
    "st15_liveness",
    """WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'node' ELSE 'client' END AS kind, max(ts) AS last FROM events GROUP BY user_id)
    SELECT user_id, kind, (epoch_us(now) - epoch_us(last)) / 1e6 AS silent, (epoch_us(now) - epoch_us(last)) / 1e6 > CASE kind WHEN 'node' THEN 86400.0 ELSE 432000.0 END AS expired FROM l, n""",
)
def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("at")).first()[0]
    beats = e.select("user_id", "at", F.when(F.col("user_id") % 2 == 0, "node").otherwise("client").alias("kind"))
    return V.liveness(beats, "user_id", "at", F.lit(now), {"node": 86400.0, "client": 432000.0})


@add(
    "st18_retention",
    """WITH n AS (SELECT max(ts) - INTERVAL '20' DAY AS edge FROM events), r AS (SELECT event_id, ts FROM events WHERE event_type <> 'view'), a AS (SELECT event_id FROM events WHERE event_id % 3 = 0)
    SELECT event_id, 'record' AS kind, 'old' AS why FROM r, n WHERE ts < edge UNION ALL SELECT a.event_id, 'artefact', CASE WHEN r.event_id IS NULL THEN 'orphan' ELSE 'old' END FROM a LEFT JOIN r USING (event_id), n WHERE r.event_id IS NULL OR r.ts < edge""",
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records, a third of their ids as artefacts, some of which never had a record."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("at")).first()[0]
    return V.retention(e.where("event_type <> 'view'"), e.where("event_id % 3 = 0").select("event_id"), "event_id", "at", F.lit(now), 20)


@add(
    "d2_group_status",
    """WITH j AS (SELECT o_custkey AS g, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS s FROM orders), t AS (SELECT g, count(*) AS n, count(*) FILTER (s = 'completed') AS c, count(*) FILTER (s = 'failed') AS f, count(*) FILTER (s = 'pending') AS p FROM j GROUP BY g)
    SELECT g AS group_id, n AS jobs, c AS completed, f AS failed, c = n AS complete, CASE WHEN c = n THEN 'completed' WHEN f > 0 THEN 'failed' WHEN p = n THEN 'pending' ELSE 'processing' END AS status FROM t""",
)
def group_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    return V.group_status(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("job_id"), status.alias("status")))


@add(
    "d3_cancelled_jobs",
    """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 5 = 0 AND s NOT IN ('completed', 'failed') THEN 'cancelled' ELSE s END AS status, o_orderkey % 5 = 0 AND s IN ('completed', 'failed') AS refused
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS s FROM orders)""",
)
def cancelled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"))
    return V.cancelled(jobs, jobs.where("job_id % 5 = 0"))


@add(
    "d7_expanded_queries",
    """WITH q AS (SELECT item_id, text, CASE WHEN item_id % 4 = 3 THEN NULL ELSE lower(substr(replace(text, chr(10), ' '), 1, 40)) || chr(10) || '- note' || chr(10) || chr(10) || 'about ' || item_id END AS x FROM benchmark),
    l AS (SELECT item_id, CASE WHEN x IS NULL THEN [text] ELSE list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(l)), lambda l: l <> '' AND NOT starts_with(l, '-')) END AS l, x IS NULL AS failed FROM q)
    SELECT item_id AS query_id, failed, CAST(unnest(range(len(l))) AS INTEGER) AS place, unnest(l) AS query FROM l""",
)
def expanded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expander that fails for a quarter of the queries, and else gives two and a note."""
    lines = F.concat(F.lower(F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 40)), F.lit("\n- note\n\nabout "), F.col("query_id").cast("string"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return V.expand(asked, lambda q: q.withColumn("expansion", F.when(F.col("query_id") % 4 != 3, lines)))


@add("ev4_table_markers", "SELECT doc_id % 50 AS part, CAST(sum(doc_id % 3) AS BIGINT) AS tables, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + len(regexp_extract_all(coalesce(text, ''), '\\|---\\|'))) AS BIGINT) AS markers, CASE WHEN sum(doc_id % 3) > 0 THEN round(least(100.0::DOUBLE, 100.0::DOUBLE * sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + len(regexp_extract_all(coalesce(text, ''), '\\|---\\|'))) / sum(doc_id % 3)), 1) ELSE 0 END AS quality FROM documents GROUP BY 1")
def table_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a table's separator put into every second, against a count of tables found."""
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, "| a |\n| --- |\n").otherwise(""), F.coalesce("text", F.lit("")))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("part"), text.alias("text"), (F.col("doc_id") % 3).alias("table_count"))
    return V.table_quality(docs, ["part"])


_GREETS = " OR ".join(f"contains(lower(q), '{g}')" for g in GREETINGS)


@add(
    "ev3_intent_accuracy",
    f"""WITH q AS (SELECT item_id, CASE WHEN item_id % 3 = 1 THEN 'Hi there' WHEN item_id % 3 = 2 THEN 'hello' ELSE text END AS q FROM benchmark), r AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'rag' ELSE 'general' END AS expected, CASE WHEN length(q) < 10 AND ({_GREETS}) THEN 'general' ELSE 'rag' END AS actual FROM q)
    SELECT expected, count(*) AS n, count(*) FILTER (expected = actual) AS "right", round(count(*) FILTER (expected = actual) / count(*), 6) AS accuracy FROM r GROUP BY expected""",
)
def intent_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The router's intent of greetings and questions against what they are."""
    q = F.when(F.col("item_id") % 3 == 1, "Hi there").when(F.col("item_id") % 3 == 2, "hello").otherwise(F.col("text"))
    asked = table(spark, sf_dir, "benchmark").select(q.alias("q"), F.when(F.col("item_id") % 3 == 0, "rag").otherwise("general").alias("expected"))
    return V.accuracy(asked, ["expected"], F.col("expected"), intent(F.col("q")))


@add("ev5_question_set")
def question_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of each source, each asked about the longest terms of its first sentence."""
    from ..plugins import extractive_answer, keyword_rewrite

    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "source", "text")
    first = F.split("text", r"(?<=[.?!])\s", 2)
    return V.question_set(pages, lambda p: p.withColumn("question", keyword_rewrite(F.get(first, F.lit(0)))).withColumn("answer", extractive_answer(F.col("question"), F.col("text"))))


@add(
    "ev7_metadata_saving",
    """WITH j AS (SELECT source, octet_length(encode(CAST(json_object('doc_id', doc_id, 'lang', lang, 'n_chars', n_chars, 'hash', md5(coalesce(text, ''))) AS VARCHAR))) AS b, octet_length(encode(CAST(json_object('doc_id', doc_id, 'lang', lang) AS VARCHAR))) AS a FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL)
    SELECT source, CAST(sum(b) AS BIGINT) AS before_bytes, CAST(sum(a) AS BIGINT) AS after_bytes, round(1 - sum(a) / sum(b), 6) AS saving FROM j GROUP BY source""",
)
def metadata_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("lang is not null and n_chars is not null").select("source", "doc_id", "lang", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    return V.saving(rows, ["source"], ["doc_id", "lang", "n_chars", "hash"], ["doc_id", "lang"])


@add(
    "a16_half_trend_within",
    """WITH n AS (SELECT max(ts) - INTERVAL '7' DAY AS edge FROM events), w AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS k FROM events, n WHERE ts >= edge),
    m AS (SELECT event_type, avg(value) FILTER (i < k // 2) AS a, avg(value) FILTER (i >= k // 2) AS b FROM w GROUP BY event_type) SELECT event_type, round(a, 6) AS first_half, round(b, 6) AS second_half, CASE WHEN b > a THEN 'degrading' ELSE 'improving' END AS trend FROM m""",
)
def half_trend_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of both halves of the last seven days' events."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    return M.half_trend(M.within(e, "ts", F.lit(now), 7 * 24 * 60), ["event_type"], "value", ["ts", "event_id"])


@add(
    "a20_usage_of_last",
    """WITH l AS (SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8) SELECT user_id, max(value) AS peak, round(avg(value), 6) AS mean, count(*) AS n FROM l GROUP BY user_id""",
)
def usage_of_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak and mean of each node's last eight readings."""
    last = M.last_n(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 8)
    return last.groupBy("user_id").agg(F.max("value").alias("peak"), F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@add(
    "a27_rollback_stats",
    """SELECT event_type AS kind, count(*) AS rollbacks, count(*) FILTER (value >= 10) AS completed, count(*) FILTER (value < 10) AS failed, round(count(*) FILTER (value >= 10) / count(*), 6) AS success_rate, round(coalesce(avg(value) FILTER (value >= 10), 0), 6) AS mean_loss, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY event_type""",
)
def rollback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.when(F.col("value") >= 10, "completed").otherwise("failed").alias("status"), F.col("value").alias("loss"), F.length("props").alias("bytes"))
    return M.rollback_stats(e, ["kind"])


@add("s7_performance_csv", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS Timestamp, event_type AS Model, round(value, 3) AS TTFT, round(value / 3, 3) AS Thinking_Time, round(value / 7, 3) AS Answer_Time, round(value * 2, 3) AS Total_Time, event_id AS Tokens, round(value / 9, 2) AS TPS, substr('asked ' || props, 1, 100) AS Query FROM events")
def performance_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine columns of the metrics log, written and read back."""
    path = snapshots.scratch(spark, "metrics")
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("model"), v.alias("ttft"), (v / 3).alias("thinking"), (v / 7).alias("answer"), (v * 2).alias("total"), F.col("event_id").alias("tokens"), (v / 9).alias("tps"), F.concat(F.lit("asked "), F.col("props")).alias("query"))
    snapshots.write_performance_csv(rows, path)
    return snapshots.read_performance_csv(spark, path)


@add("s14_evaluation_report", "SELECT 'detail' AS part, CAST(doc_id AS VARCHAR) AS name, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM labels UNION ALL SELECT 'summary', 'mean', round(avg(quality), 6), round(avg(toxic), 6) FROM labels")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of all scores and the rows they are of, written as one report and read back."""
    path = snapshots.scratch(spark, "report")
    services.write_report(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", ["quality", "toxic"], path)
    return services.read_report(spark, path, ["quality", "toxic"])


@add("s11_upload_contents", "SELECT 'page-' || page_id || '.txt' AS name, sha256(html) AS hash, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages WHERE page_id % 5 <> 0")
def upload_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages uploaded one a file, of which those of another suffix are turned away; their bytes and hashes."""
    path = snapshots.scratch(spark, "landing")
    suffix = F.when(F.col("page_id") % 5 == 0, ".bin").otherwise(".txt")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), suffix).alias("name"), F.concat(F.coalesce("html", F.lit("")), F.lit("\x00")).alias("content"))  # a last byte, since Spark's readers skip empty files
    if not services.land(spread(pages), path):
        return spark.createDataFrame([], "name string, hash string, bytes bigint")
    files = services.uploads(spark, f"{path}/*", ".txt")
    return files.select("path", F.substring("content", F.lit(1), F.octet_length("content") - 1).alias("content")).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("bigint").alias("bytes"))
