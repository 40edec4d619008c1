"""Shared parts of the corpus operators: words, exact distributed running sums, checkpoints, byte batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the query contracts: a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: A checkpoint that took so many seconds leaves shuffle files worth dropping at once.
COLLECT_AFTER_S = 0.15
#: Rows in an Arrow batch at most.
BATCH_RECORDS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Set the session to hand Python a few megabytes at a time: batches count in the JVM and in every worker.

    For the programs that own a session (the registered queries, the pipeline's stages); operators leave sessions alone.
    """
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_RECORDS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_RECORDS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def tidy(function: Callable) -> Callable:
    """A function over batches that gives free memory back to the system when its task ends, since workers live on."""

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        release()

    return run


def release() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the folder that shared_folder names: columnar files take a fraction of a checkpoint's."""
    spark = df.sparkSession
    begun = time.monotonic()
    path = f"{shared_folder(spark)}/corpuscle-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    if time.monotonic() - begun > COLLECT_AFTER_S:
        gc.collect()
        spark._jvm.System.gc()  # lets Spark's cleaner drop shuffle files that only the lineage just cut still needed
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set: a temporary one in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="corpuscle-")


def unit_hash(*parts: Column) -> Column:
    """A reproducible uniform number in (0, 1) from the MD5 of the parts, the same in any SQL engine."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, name: str, peers: bool = False) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier rows of the same key and the row itself, exactly;
    with ``peers``, rows equal in ``order`` count together.

    ``bucket`` is a number that does not fall along ``order``. Rows are summed up within (key, bucket), and the totals of
    the buckets, at most one row a bucket and key, give each bucket its start. So a key that holds a third of all rows
    spreads over its buckets. Adds ``<name>_total`` too, the sum over the whole key.
    """
    df = df.withColumns({"_b": bucket.cast("bigint"), "_v": value})
    keyed = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("null")).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    totals = df.groupBy(*keyed, "_b").agg(F.sum("_v").alias("_sum"))
    start = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *names, "_b", F.coalesce(F.sum("_sum").over(start), F.lit(0)).alias("_start"), F.sum("_sum").over(Window.partitionBy(*names)).alias(f"{name}_total")
    )
    ordered = Window.partitionBy(*names, "_b").orderBy(*order)
    within = (ordered.rangeBetween if peers else ordered.rowsBetween)(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumns({n: c for n, c in zip(names, keyed, strict=True)})
    return (
        rows.withColumn("_within", F.sum("_v").over(within))
        .join(totals, [*names, "_b"])
        .withColumn(name, F.col("_start") + F.col("_within"))
        .drop("_b", "_v", "_start", "_within", *names)
    )


def place_among(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are at most the value, by binary search."""
    if not cuts:
        return F.lit(0)
    borders = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")  # a constant, folded once
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    here = lambda at, step: (at + step <= len(cuts)) & (F.get(borders, at + step - 1) <= value)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(here(at, step), at + step).otherwise(at))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the n + 1 offsets into them; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row stands alone. Bounds what one step holds in memory."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit mixing hash, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
