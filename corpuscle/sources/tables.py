"""Reading the driver's tables. Paths may name any store that Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input that Spark reads in one task, as a rule.
SPLIT = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input dealt to all cores, for steps that cost much more than moving their rows: files of one row group are one task otherwise.

    Small is what Spark itself estimates at less than a split a core; a larger input has tasks enough and stays as it is. Only the plan differs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores) if size < cores * SPLIT else df
