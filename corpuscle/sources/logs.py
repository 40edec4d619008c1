"""Log lines as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def scan(lines: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """The groups of ``pattern`` as columns, for the lines that match it."""
    hit = lines.where(F.regexp_like("value", F.lit(pattern)))
    return hit.select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])
