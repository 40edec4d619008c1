"""Sources and sinks (inventory S) as round trips: what is written is read back, and must equal what SQL says of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pages, services, snapshots
from ..sources.tables import table
from .registry import REGISTRY

add = REGISTRY.add


@add("s5_snapshot_round_trip", "SELECT doc_id, md5(text) AS digest, source FROM documents")
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved with its manifest, loaded with the check of every row (S4 and S5)."""
    path = snapshots.scratch(spark, "snapshot")
    snapshots.save(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), "source"), path, ["doc_id"])
    rows = snapshots.load(spark, path, ["doc_id"])
    assert rows is not None
    return rows


@add(
    "s6_word_coordinates",
    """SELECT page_id AS page, CASE WHEN page_id % 3 = 0 THEN length(html) END AS width FROM pages""",
)
def word_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes in a side table by file, filled in where a page is flagged and has none (S6, J1)."""
    path = snapshots.scratch(spark, "coordinates")
    pages = table(spark, sf_dir, "pages").select(F.md5(F.split_part("url", F.lit("/"), F.lit(3))).alias("file_hash"), F.col("page_id").alias("page"), F.length("html").alias("width"), (F.col("page_id") % 3 == 0).alias("has_coordinates"))
    box = "array<struct<word:string,width:int>>"
    snapshots.save_coordinates(pages.where("has_coordinates").select("file_hash", "page", F.array(F.struct(F.lit("w").alias("word"), "width")).cast(box).alias("words")), path)
    bare = pages.select("file_hash", "page", "has_coordinates", F.lit(None).cast(box).alias("words"))
    return snapshots.hydrate(bare, spark.read.parquet(path)).select("page", F.get("words", F.lit(0))["width"].cast("bigint").alias("width"))


@add("s7_metrics_csv", "SELECT event_id, round(value, 3) AS ttft, substr(event_type || ' ' || props, 1, 100) AS query FROM events")
def metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = snapshots.scratch(spark, "metrics")
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("ttft"), F.concat_ws(" ", "event_type", "props").alias("query"))
    snapshots.write_metrics_csv(e, path)
    return spark.read.csv(path, header=True, schema="event_id bigint, ttft double, query string", escape="\\")


@add("s8_history_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def history_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = snapshots.scratch(spark, "history")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    snapshots.append_history(turns.where("turn % 2 = 0"), path)
    snapshots.append_history(turns.where("turn % 2 = 1"), path)
    return spark.read.schema(turns.schema).json(path)


@add("s9_log_writer", "SELECT event_type || ',' || event_id AS payload, 'csv' AS folder FROM events WHERE event_id % 2 = 0 UNION ALL SELECT '{\"event_id\":' || event_id || '}', 'jsonl' FROM events WHERE event_id % 2 = 1")
def log_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = snapshots.scratch(spark, "log")
    even = F.col("event_id") % 2 == 0
    entries = table(spark, sf_dir, "events").select(F.when(even, F.lit("list")).otherwise(F.lit("dict")).alias("kind"), F.when(even, F.concat_ws(",", "event_type", "event_id")).otherwise(F.to_json(F.struct("event_id"))).alias("payload"))
    services.write_log(entries, path)
    return services.read_log(spark, path, "csv").withColumn("folder", F.lit("csv")).unionByName(services.read_log(spark, path, "jsonl").withColumn("folder", F.lit("jsonl")))


@add("s10_metrics_json", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = snapshots.scratch(spark, "report")
    services.export_metrics(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")), path)
    return spark.read.schema("event_type string, n bigint, mean double").json(path)


@add("s11_uploads", "SELECT count(*) AS files FROM region")
def uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a region as an upload; the commit's own files have another suffix and are turned away."""
    path = snapshots.scratch(spark, "landing")
    rows = table(spark, sf_dir, "region").select("r_name")
    rows.select("r_name", F.col("r_name").alias("k")).write.partitionBy("k").text(path, lineSep="\n")
    return services.uploads(spark, f"{path}/*", ".txt").agg(F.count(F.lit(1)).alias("files"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files of five pages each, written and read back as bytes; of three pages one has its heading."""
    path = snapshots.scratch(spark, "files")
    html = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.replace("html", F.lit("<h1>"), F.lit("<p>")))
    rows = table(spark, sf_dir, "pages").select(F.expr("page_id div 5").alias("file"), "page_id", html.alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "page_id").select("file", pages.ended(F.col("value")).alias("value")).write.partitionBy("file").text(path, lineSep="\f")
    return pages.read_pages(spark, path, pages.ended_pages, "*.txt").withColumn("file", F.regexp_extract("path", "/file=([0-9]+)/", 1).cast("bigint"))


_FILES = """h AS (SELECT page_id, page_id // 5 AS file, row_number() OVER (PARTITION BY page_id // 5 ORDER BY page_id) AS page, count(*) OVER (PARTITION BY page_id // 5) AS total_pages,
    CASE WHEN page_id % 3 = 0 THEN nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') END AS title FROM pages)"""


@add(
    "s1_page_files",
    f"WITH {_FILES} SELECT file, CAST(page AS INTEGER) AS page, CAST(total_pages AS INTEGER) AS total_pages, coalesce(last_value(replace(replace(replace(trim(title), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') IGNORE NULLS) OVER (PARTITION BY file ORDER BY page ROWS UNBOUNDED PRECEDING), 'Introduction/Root') AS section FROM h",
)
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of files with the section that holds on them, carried forward inside each file."""
    return _scanned(spark, sf_dir).select("file", "page", "total_pages", "section")


@add("s3_page_layout")
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, covered area and columns of the same pages."""
    return pages.layout(_scanned(spark, sf_dir)).select(F.regexp_extract("path", "/file=([0-9]+)/", 1).cast("bigint").alias("file"), "page", "n_blocks", F.round("covered", 6).alias("covered"), "multi_column")


@add("s15_state_registry", "SELECT s_suppkey, s_nationkey, 'live' AS state FROM supplier WHERE s_acctbal > 0")
def state_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = snapshots.scratch(spark, "registry")
    rows = table(spark, sf_dir, "supplier")
    services.save_registry(rows.select("s_suppkey", "s_nationkey", F.lit("planned").alias("state")), path, 1)
    services.save_registry(rows.where("s_acctbal > 0").select("s_suppkey", "s_nationkey", F.lit("live").alias("state")), path, 2)
    return services.load_registry(spark, path, "s_suppkey bigint, s_nationkey bigint, state string")
