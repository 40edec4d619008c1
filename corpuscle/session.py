"""Session factory with the settings that every query of this library assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(cores: int | str | None = "*", app: str = "corpuscle", **conf: str) -> SparkSession:
    """A session (UTC, AQE, Arrow): local with so many cores, or with None on the cluster that submitted the program.

    On a cluster, shuffle partitions and memory are left to its own configuration. Keyword names use ``__`` in place of dots.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder
    if cores is None:
        for name in ("spark.sql.shuffle.partitions", "spark.driver.memory"):
            if name.replace(".", "__") not in conf:
                del settings[name]
    else:
        builder = builder.master(f"local[{cores}]")
    spark = builder.appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Set the session to hand Python that much at a time, of what has large rows too; for programs that own a session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
