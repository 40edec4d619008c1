"""Frames and running sums over long series, cut into blocks of neighbouring rows.

A window partitioned by a series alone puts all of the series into one task. Here every row gets its exact place in its
series (``metrics.numbered``, by ranges), and rows of neighbouring places form a block. A frame that reaches a bounded number
of rows back or ahead is computed within a block that also holds as many rows of the blocks beside it (its halo); an
unbounded one adds what the blocks before sum up to. Results are those of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .metrics import _same, numbered

#: Rows of a block, and at least, how many halos fit in one.
BLOCK_ROWS = 4096


def with_frames(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Callable[[WindowSpec], Column]], behind: int = 0, ahead: int = 0, size: int = BLOCK_ROWS) -> DataFrame:
    """Adds columns over a window along each series, whose frames reach at most ``behind`` rows back and ``ahead`` rows on.

    Each column is made from a window ordered along the series; row_number and unbounded frames have no meaning in it.
    """
    size = max(size, behind, ahead, 1)
    names = df.columns
    place = F.col("_at") % size
    block = F.floor(F.col("_at") / size).cast("bigint")
    rows = numbered(df, keys, order).select(*names, "_at", block.alias("_own"), F.explode(F.array_compact(F.array(block, F.when(place >= size - behind, block + 1), F.when((place < ahead) & (block > 0), block - 1)))).alias("_block"))
    along = Window.partitionBy(*keys, "_block").orderBy("_at")
    framed = rows.withColumns({name: make(along) for name, make in columns.items()})
    return framed.where("_block = _own").select(*[n for n in names if n not in columns], *columns)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Adds the sum of ``value`` over all rows of the series before a row, 0 for the first."""
    names = [n for n in df.columns if n != name]
    rows = numbered(df.withColumn("_v", value), keys, order).withColumn("_block", F.floor(F.col("_at") / size).cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "_block").agg(F.sum("_v").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    within = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    joined = rows.alias("l").join(starts.alias("r"), _same([*keys, "_block"], "l", "r"))
    return joined.select(*[f"l.{n}" for n in names], (F.col("_start") + F.col("_within")).alias(name))
