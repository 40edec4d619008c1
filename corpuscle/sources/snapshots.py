"""Snapshots of tables with a manifest, coordinate side tables, and report and history sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder of spark.checkpoint.dir; in local mode a temporary one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='corpuscle-')}/{name}-{uuid.uuid4().hex}"


def manifest(df: DataFrame, keys: list[str]) -> DataFrame:
    """A hash of each row by its keys."""
    return df.select(*keys, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("_hash"))


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def saved(spark: SparkSession, path: str) -> bool:
    """Whether a snapshot is there: its manifest is written last, and counts once its own commit has ended."""
    fs, at = _file_system(spark, f"{path}/manifest/_SUCCESS")
    return fs.exists(at)


def purge(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def save(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write rows, then their manifest; a snapshot that is there stays. What a crash in between leaves is written anew by the next save."""
    spark = df.sparkSession
    if saved(spark, path):
        return
    df.write.mode("overwrite").parquet(f"{path}/rows")
    manifest(spark.read.schema(df.schema).parquet(f"{path}/rows"), keys).write.mode("overwrite").parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The rows if every one matches the manifest and none is missing, else None; a snapshot that does not match is deleted."""
    if not saved(spark, path):
        return None
    try:
        rows = spark.read.parquet(f"{path}/rows")
        now = manifest(rows, keys)
        told = spark.read.schema(now.schema).parquet(f"{path}/manifest")
        on = [*keys, "_hash"]
        good = now.join(told, on, "left_anti").limit(1).unionByName(told.join(now, on, "left_anti").limit(1)).isEmpty()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN.WITH_SUGGESTION"):
            raise
        good = False
    if not good:
        purge(spark, path)
        return None
    return rows


def save_coordinates(df: DataFrame, path: str) -> None:
    """Word boxes by file: (file_hash, page, words array<struct>); reads of one file touch its folder only."""
    df.write.mode("append").partitionBy("file_hash").parquet(path)


def hydrate(docs: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Coordinates for rows that are flagged and have none yet."""
    side = coordinates.select("file_hash", "page", F.col("words").alias("_w"))
    filled = F.when(F.col("has_coordinates") & F.col("words").isNull(), F.col("_w")).otherwise(F.col("words"))
    return docs.join(side, ["file_hash", "page"], "left").withColumn("words", filled).drop("_w")


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """Rounded metrics as CSV with a header; queries cut at 100 characters."""
    df.select(*[F.round(c, 3).alias(c) if t == "double" else F.substring(c, 1, 100).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]).write.mode("append").csv(path, header=True)


#: Fixed columns of the performance log and the digits of their numbers.
PERFORMANCE = {"Timestamp": None, "Model": None, "TTFT": 3, "Thinking_Time": 3, "Answer_Time": 3, "Total_Time": 3, "Tokens": None, "TPS": 2, "Query": None}
_TOLD = ("timestamp", "model", "ttft", "thinking", "answer", "total", "tokens", "tps", "query")


def write_performance_csv(df: DataFrame, path: str) -> None:
    """timestamp, model, ttft, thinking, answer, total, tokens, tps, query as the nine columns of the log; what is missing is unknown or 0."""
    kinds = {"timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "model": lambda c: F.coalesce(c, F.lit("unknown")), "tokens": lambda c: F.coalesce(c.cast("bigint"), F.lit(0)), "query": lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 100)}
    number = lambda digits: lambda c: F.round(F.coalesce(c.cast("double"), F.lit(0.0)), digits)
    held = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("timestamp" if name == "timestamp" else "string")
    columns = [kinds.get(name, number(digits))(held(name)).alias(title) for name, (title, digits) in zip(_TOLD, PERFORMANCE.items(), strict=True)]
    df.select(*columns).write.mode("append").csv(path, header=True, escape='"')


def read_performance_csv(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"Tokens": "bigint", "Timestamp": "string", "Model": "string", "Query": "string"}
    return spark.read.csv(path, header=True, escape='"', schema=", ".join(f"{c} {kinds.get(c, 'double')}" for c in PERFORMANCE))


def append_history(df: DataFrame, path: str) -> None:
    """One JSON object a line; a time where none is given."""
    stamped = df if "timestamp" in df.columns else df.withColumn("timestamp", F.current_timestamp())
    stamped.write.mode("append").json(path)
