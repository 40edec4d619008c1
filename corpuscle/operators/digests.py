"""Digests of tables by ranges of ids, so that two copies can be compared, and what differs found, without gathering ids in a row.

A leaf is a range of ids of one width; its digest adds up a hash of each row, so rows are summed up where they are. A node of the next
level covers ``fan`` leaves. Copies are compared from the top: only below nodes that differ is anything looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF, FAN = 1024, 64


def tree(rows: DataFrame, keys: list[str], key: str, columns: list[str], leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """keys (of other names), level, node, n, digest: leaves at level 0, up to the level of one node a key. Rows with a null id lie in leaf null."""
    content = F.xxhash64(F.col(key), *[F.col(c) for c in columns]).cast("decimal(38,0)")
    top = rows.agg(F.max(F.abs(F.floor(F.col(key) / leaf)))).first()[0] or 0
    level = rows.groupBy(*keys, F.floor(F.col(key) / leaf).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum(content).alias("digest")).withColumn("level", F.lit(0))
    columns = [*keys, "level", "node", "n", "digest"]
    out, at = level.select(*columns), 0
    while True:
        at += 1
        top //= fan
        level = level.groupBy(*keys, F.floor(F.col("node") / fan).alias("node")).agg(F.sum("n").alias("n"), F.sum("digest").alias("digest")).withColumn("level", F.lit(at))
        out = out.unionByName(level.select(*columns))
        if not top:
            return out


def differing(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The leaves (keys, node, n, other_n) in which two trees differ."""
    both = one.where("level = 0").alias("a").join(other.where("level = 0").alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "node")], "full")
    named = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in (*keys, "node")]
    return both.where(~F.col("a.digest").eqNullSafe(F.col("b.digest")) | ~F.col("a.n").eqNullSafe(F.col("b.n"))).select(*named, F.coalesce("a.n", F.lit(0)).alias("n"), F.coalesce("b.n", F.lit(0)).alias("other_n"))


def consistent(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """keys, consistent: whether the top digests agree."""
    levels = lambda t: t.groupBy(*keys, "level").agg(F.sum("n").alias("n"), F.sum("digest").alias("digest"))  # noqa: E731  the top may have a node of null ids
    top = lambda t: levels(t).groupBy(*keys).agg(F.max_by(F.struct(F.col("n"), F.col("digest")), "level").alias("top"))
    both = top(one).alias("a").join(top(other).alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], F.col("a.top").eqNullSafe(F.col("b.top")).alias("consistent"))
