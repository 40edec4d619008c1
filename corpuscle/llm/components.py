"""Connected components of an edge table by alternating large and small stars, entirely in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Large star: every node sends its larger neighbours to its smallest one. Small star: every node sends its smaller
    neighbours and itself to the smallest. Repeated until nothing changes, the edges are stars around the roots. A node's
    neighbours are never gathered in one row: the smallest is an aggregate, and the rest is a join that AQE can split.
    """
    now = checkpoint(edges.select(F.least("a", "b").alias("r"), F.greatest("a", "b").alias("v")).where("r <> v").distinct())
    state = None
    while True:
        both = now.select(F.col("r").alias("x"), F.col("v").alias("y")).unionAll(now.select(F.col("v").alias("x"), F.col("r").alias("y")))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("m").alias("r"), F.col("y").alias("v")).where("r <> v").distinct()
        least = large.groupBy("v").agg(F.min("r").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("r"), F.explode(F.array("r", "v")).alias("v")).where("r <> v").distinct()
        now = checkpoint(small)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("r", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("v").alias("node"), F.col("r").alias("root")).unionAll(now.select(F.col("r").alias("node"), F.col("r").alias("root")).distinct())
        state = seen
