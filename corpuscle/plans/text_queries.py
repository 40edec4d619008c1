"""Text functions applied to the tables (inventory T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .registry import REGISTRY

add = REGISTRY.add
_DOC = "SELECT doc_id, {} FROM documents"


def _docs(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


TOKENS_SQL = """CASE WHEN len(regexp_extract_all(lower(text), '[가-힣]{2,}|[a-z]{2,}|[0-9]+')) = 0
    THEN list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')
    ELSE list_distinct(regexp_extract_all(lower(text), '[가-힣]{2,}|[a-z]{2,}|[0-9]+')) END"""


@add("t1_index_tokens", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)")
def index_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, T.index_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join(F.sort_array("t"), " ")).alias("tokens_md5"))


@add("t2_whitespace_normalise", _DOC.format(r"md5(trim(regexp_replace(translate(text, chr(13) || chr(10) || chr(9), '   '), '\s+', ' ', 'g'))) AS clean_md5"))
def whitespace_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, F.md5(T.squeeze(F.col("text"))).alias("clean_md5"))


@add(
    "t3_query_clean",
    r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(q), '^\s*[0-9]+[.)]\s*', ''), '^\s*[-*•]\s*', ''), '^\s*(?:example|query|question)\s*:\s*', '', 'i'), '^["'']+|["'']+$', '', 'g')) AS clean
    FROM (SELECT item_id, '1. Query: "' || split_part(text, chr(10), 1) || '"' AS q FROM benchmark)""",
)
def query_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('1. Query: "'), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit('"'))
    return table(spark, sf_dir, "benchmark").select("item_id", T.clean_query(raw).alias("clean"))


@add(
    "t4_latex_rewrite",
    r"""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(q, '\\\[(.*?)\\\]', '$$\1$$', 'gs'), '\\\((.*?)\\\)', '$\1$', 'gs'), '\\\$', '$', 'g') AS latex
    FROM (SELECT item_id, '\[' || text || '\] and \(x^2\) for \$5' AS q FROM benchmark)""",
)
def latex_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("\\["), F.col("text"), F.lit("\\] and \\(x^2\\) for \\$5"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.latex_delimiters(raw).alias("latex"))


@add(
    "t5_rough_token_count",
    r"""SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE CAST(floor((n - o) / 3.0 + o * 2.5) AS BIGINT) + 1 END AS tokens
    FROM (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS o FROM documents)""",
)
def rough_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, T.rough_tokens(F.col("text")).alias("tokens"))


@add("t6_quarter_token_count", _DOC.format("CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens"))
def quarter_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, T.quarter_tokens(F.col("text")).alias("tokens"))


@add("t7_token_count_of_list", "SELECT source, CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END) AS BIGINT) AS tokens FROM documents GROUP BY source")
def token_count_of_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(T.quarter_tokens(F.col("text"))).alias("tokens"))


@add(
    "t8_stream_token_estimates",
    "SELECT conv_id, turn, greatest(1, length(text) // 2) AS custom, greatest(1, length(text) // 4) AS message, len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '')) AS final FROM conversations",
)
def stream_token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != "")).cast("bigint")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.half_tokens(F.col("text")).alias("custom"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("message"), words.alias("final"))


@add("t9_fast_hash", _DOC.format("CASE WHEN text = '' THEN repeat('0', 16) ELSE substr(md5(text), 1, 16) END AS hash"))
def fast_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, T.fast_hash(F.col("text")).alias("hash"))


@add("t10_content_hash", _DOC.format("sha256(text) AS hash"))
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, F.sha2("text", 256).alias("hash"))


@add("t11_composite_cache_key", "SELECT doc_id, substr(sha256(substr(md5(text), 1, 8) || ':' || lang), 1, 16) AS key16, substr(sha256(substr(md5(text), 1, 8) || ':' || lang), 1, 12) AS key12 FROM documents")
def composite_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.substring(F.md5("text"), 1, 8), F.col("lang")]
    return _docs(spark, sf_dir, T.composite_key(parts, 16).alias("key16"), T.composite_key(parts, 12).alias("key12"))


@add(
    "t12_query_documents_key",
    """SELECT lang, substr(sha256('{"docs": [' || string_agg('"' || doc_id || '"', ', ' ORDER BY doc_id) || '], "query": "' || lang || '"}'), 1, 16) AS key FROM documents GROUP BY lang""",
)
def query_documents_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda i: F.concat(F.lit('"'), i.cast("string"), F.lit('"'))), ", ")
    key = F.concat(F.lit('{"docs": ['), ids, F.lit('], "query": "'), F.col("lang"), F.lit('"}'))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(ids.alias("ids")).select("lang", F.substring(F.sha2(F.concat(F.lit('{"docs": ['), F.col("ids"), F.lit('], "query": "'), F.col("lang"), F.lit('"}')), 256), 1, 16).alias("key"))


_CITED = "'as shown [DOC 1, p.' || (item_id % 7 + 1) || '] and (p.' || (item_id % 5 + 1) || ') or [' || (item_id % 3 + 1) || ']'"


@add(
    "t13_citation_pages",
    rf"""SELECT item_id, pos, CAST(coalesce(nullif(regexp_extract(c, 'p\.\s*([0-9]+)', 1), ''), regexp_extract(c, '([0-9]+)', 1)) AS INTEGER) AS page FROM (
    SELECT item_id, unnest(l) AS c, unnest(range(len(l))) AS pos FROM (SELECT item_id, regexp_extract_all({_CITED}, '\[(?:DOC [0-9]+, )?(?:p\.\s*)?[0-9]+\]|\(p\.\s*[0-9]+\)') AS l FROM benchmark))""",
)
def citation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.expr(_CITED.replace("'as", "'as"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all(cited, F.lit(r"\[(?:DOC [0-9]+, )?(?:p\.\s*)?[0-9]+\]|\(p\.\s*[0-9]+\)"), F.lit(0))).alias("pos", "c"))
    page = F.coalesce(F.nullif(F.regexp_extract("c", r"p\.\s*([0-9]+)", 1), F.lit("")), F.regexp_extract("c", "([0-9]+)", 1)).cast("int")
    return rows.select("item_id", F.col("pos").cast("bigint").alias("pos"), page.alias("page"))


@add(
    "t14_bibliography",
    r"""SELECT item_id, CAST(regexp_extract(line, '^\[([0-9]+)\]', 1) AS INTEGER) AS ref, trim(regexp_extract(line, '^\[[0-9]+\]\s*(.*)$', 1)) AS entry FROM (
    SELECT item_id, unnest(string_split('[1] ' || split_part(text, chr(10), 1) || chr(10) || 'no entry' || chr(10) || '[2] Smith (2020)', chr(10))) AS line FROM benchmark) WHERE regexp_matches(line, '^\[[0-9]+\]')""",
)
def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("[1] "), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("\nno entry\n[2] Smith (2020)"))
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.regexp_like("line", F.lit(r"^\[[0-9]+\]")))
    keyed = lines.select("item_id", "pos", F.regexp_extract("line", r"^\[([0-9]+)\]", 1).cast("int").alias("ref"), F.trim(F.regexp_extract("line", r"^\[[0-9]+\]\s*(.*)$", 1)).alias("entry"))
    return keyed.groupBy("item_id", "ref").agg(F.max_by("entry", "pos").alias("entry"))  # later entries replace earlier ones


_REFERENCES = "'[1] First entry.' || chr(10) || '(2) ' || split_part(text, chr(10), 1) || chr(10) || '3. Third' || chr(10) || 'no entry' || chr(10) || chr(10) || 'Smith et al. (20' || (10 + item_id % 80) || ') ' || split_part(text, ' ', 1) || chr(10) || chr(10) || 'Jones, 1999 again'"


@add(
    "t14_reference_keys",
    rf"""WITH r AS (SELECT item_id, {_REFERENCES} AS t FROM benchmark), l AS (SELECT item_id, unnest(string_split(t, chr(10))) AS l FROM r), p AS (SELECT item_id, trim(unnest(string_split(t, chr(10) || chr(10)))) AS p FROM r)
    SELECT item_id, regexp_extract(l, '{T.NUMBERED}', 1) AS key, md5(trim(regexp_extract(l, '{T.NUMBERED}', 2))) AS entry FROM l WHERE regexp_matches(l, '{T.NUMBERED}')
    UNION ALL SELECT item_id, lower(regexp_extract(p, '{T.AUTHOR_YEAR}', 1) || '_' || regexp_extract(p, '{T.AUTHOR_YEAR}', 2)), md5(p) FROM p WHERE regexp_matches(p, '{T.AUTHOR_YEAR}')""",
)
def reference_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms of keys: numbers in brackets, in parentheses, with a point, and an author with a year."""
    line, word = F.split_part("text", F.lit("\n"), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(1))
    text = F.concat(F.lit("[1] First entry.\n(2) "), line, F.lit("\n3. Third\nno entry\n\nSmith et al. (20"), (10 + F.col("item_id") % 80).cast("string"), F.lit(") "), word, F.lit("\n\nJones, 1999 again"))
    keys = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.reference_keys(text)).alias("k"))
    return keys.select("item_id", "k.key", F.md5("k.entry").alias("entry"))


@add(
    "t15_answer_prefix",
    r"""SELECT conv_id, turn, md5(trim(regexp_replace('**Answer:** ' || text, '^[#*\s]*(?:answer|result|response|conclusion)[*\s]*:[*\s]*', '', 'gim'))) AS clean_md5 FROM conversations""",
)
def answer_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.strip_answer_heading(F.concat(F.lit("**Answer:** "), F.col("text")))).alias("clean_md5"))


@add(
    "t16_section_title",
    r"""WITH p AS (SELECT page_id, trim(regexp_replace('# ' || regexp_extract(html, '<h[1-6][^>]*>([^<]*)</h', 1), '^#+\s*', '')) AS t FROM pages)
    SELECT page_id, CASE WHEN starts_with(lower(t), 'abstract') THEN 'Abstract' WHEN starts_with(lower(t), 'introduction') THEN 'Introduction' WHEN starts_with(lower(t), 'related work') THEN 'Related Work'
    WHEN starts_with(lower(t), 'method') THEN 'Methods' WHEN starts_with(lower(t), 'result') THEN 'Results' WHEN starts_with(lower(t), 'discussion') THEN 'Discussion' WHEN starts_with(lower(t), 'conclusion') THEN 'Conclusion' WHEN starts_with(lower(t), 'reference') THEN 'References'
    ELSE substr(trim(regexp_replace(CASE WHEN length(t) > 100 THEN regexp_extract(t, '^([^\n.:]*)', 1) ELSE t END, '[#*_]', '', 'g')), 1, 150) END AS title FROM p""",
)
def section_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("# "), F.regexp_extract("html", "<h[1-6][^>]*>([^<]*)</h", 1))
    return table(spark, sf_dir, "pages").select("page_id", T.section_title(raw).alias("title"))


@add("t17_language_guess", _DOC.format("CASE WHEN regexp_matches(substr(text, 1, 1000), '[가-힣]') THEN 'Korean' ELSE 'English' END AS guess"))
def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, T.language_guess(F.col("text")).alias("guess"))


@add("t18_json_in_text", "SELECT event_id, CAST(json_extract_string(regexp_extract('model says: ' || props || ' done', '(?s)\\{.*\\}'), '$.k') AS BIGINT) AS k FROM events")
def json_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("model says: "), F.col("props"), F.lit(" done"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(T.braces(said), "$.k").cast("bigint").alias("k"))


@add(
    "t19_thought_split",
    """SELECT conv_id, md5(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'system'), '')) AS thought_md5, md5(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'system'), '')) AS content_md5 FROM conversations GROUP BY conv_id""",
)
def thought_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("b"))
    joined = lambda test: F.md5(F.array_join(F.transform(F.filter("b", test), lambda x: x["text"]), ""))
    return blocks.select("conv_id", joined(lambda x: x["role"] == "system").alias("thought_md5"), joined(lambda x: x["role"] != "system").alias("content_md5"))


@add("t20_context_format", "SELECT source, md5(string_agg('### [' || lang || '] (P' || doc_id || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)) AS context_md5 FROM documents GROUP BY source")
def context_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.concat(F.lit("### ["), F.col("lang"), F.lit("] (P"), F.col("doc_id"), F.lit(")\n"), F.col("text"))
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", part.alias("p")))).alias("b"))
    return rows.select("source", F.md5(F.array_join(F.transform("b", lambda x: x["p"]), "\n\n")).alias("context_md5"))


@add("t21_pii_mask", "SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) END AS masked FROM customer")
def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.mask(F.col("c_name")).alias("masked"))


@add(
    "t22_error_classes",
    """SELECT o_orderkey, CASE WHEN contains(m, 'timeout') THEN 'The request took too long.' WHEN contains(m, 'memory') THEN 'There is not enough memory.' WHEN contains(m, 'connection') OR contains(m, 'refused') THEN 'The service cannot be reached.'
    WHEN contains(m, 'not found') THEN 'The resource was not found.' ELSE 'An unexpected error occurred.' END AS said FROM (SELECT o_orderkey, lower(CASE o_orderpriority WHEN '1-URGENT' THEN 'Read Timeout' WHEN '2-HIGH' THEN 'out of memory' WHEN '3-MEDIUM' THEN 'Connection refused' WHEN '5-LOW' THEN 'model not found' ELSE 'oops' END) AS m FROM orders)""",
)
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'Read Timeout' WHEN '2-HIGH' THEN 'out of memory' WHEN '3-MEDIUM' THEN 'Connection refused' WHEN '5-LOW' THEN 'model not found' ELSE 'oops' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.error_text(message).alias("said"))


@add(
    "t23_highlight_sentences",
    r"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '[#*_`|]', '', 'g') AS t FROM documents),
    g AS (SELECT doc_id, t, list_filter(list_transform(string_split_regex(t, '[.?!]\s+|\n'), lambda s: trim(s)), lambda s: length(s) >= 20 AND NOT regexp_matches(s, '^[0-9 .,]+$') AND NOT regexp_matches(lower(s), '^(table|figure|fig)\b|^\[[0-9]+\]')) AS l FROM p)
    SELECT doc_id, CASE WHEN len(l) > 0 THEN len(l) ELSE 1 END AS n, md5(CASE WHEN len(l) > 0 THEN array_to_string(l, '~') ELSE substr(trim(t), 1, 150) END) AS sentences_md5 FROM g""",
)
def highlight_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, T.highlight_sentences(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").cast("bigint").alias("n"), F.md5(F.array_join("l", "~")).alias("sentences_md5"))


@add("t24_clock_time", "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events")
def clock_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("clock"))


@add("t25_ttl_expiry", "SELECT event_id, epoch_us(TIMESTAMP '2024-02-01') // 1000000 - epoch_us(ts) // 1000000 > 864000 AS expired FROM events")
def ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    return table(spark, sf_dir, "events").select("event_id", T.expired(seconds, F.lit(864000), F.lit(1706745600)).alias("expired"))


@add("t26_token_rate", "SELECT event_id, round(CASE WHEN value > 0 THEN length(props) / value ELSE 0 END, 6) AS rate FROM events")
def token_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(T.rate(F.length("props"), F.col("value")), 6).alias("rate"))


@add("t27_sse_lines", "SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS sse FROM events")
def sse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.sse(F.col("event_type"), F.col("props"), F.col("event_id")).alias("sse"))


@add("t28_template_render", "SELECT c_custkey, replace(replace('Dear {name}, segment {segment}', '{name}', c_name), '{segment}', c_mktsegment) AS mail FROM customer")
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.replace(F.replace(F.lit("Dear {name}, segment {segment}"), F.lit("{name}"), F.col("c_name")), F.lit("{segment}"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", mail.alias("mail"))


@add(
    "t29_query_expansion",
    """SELECT item_id, pos, l[pos + 1] AS query FROM (SELECT item_id, l, unnest(range(len(l))) AS pos FROM (SELECT item_id, list_filter(list_transform(string_split(text || chr(10) || '- bullet' || chr(10) || '  ', chr(10)), lambda s: trim(s)), lambda s: s <> '' AND NOT starts_with(s, '-')) AS l FROM benchmark))""",
)
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.col("text"), F.lit("\n- bullet\n  "))
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.expansion_lines(answer)).alias("pos", "query")).withColumn("pos", F.col("pos").cast("bigint"))
