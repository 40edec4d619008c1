"""Fusion of hit lists from several nodes: query_id, node_id, doc_id, score, and a sequence number for stable orders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def _weight(weights: Mapping[str, float] | None, default: float = 1.0) -> Column:
    out = F.lit(float(default))
    for node, w in (weights or {}).items():
        out = F.when(F.col("node_id") == node, F.lit(float(w))).otherwise(out)
    return out


def merge_all(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out


def rrf(hits: DataFrame, weights: Mapping[str, float] | None = None, k: int = RRF_K, offset: int = 0) -> DataFrame:
    """Sum of w / (k + rank) over nodes; ranks by score within a node, ties by doc_id; ``offset`` -1 counts ranks from 0."""
    rank = F.row_number().over(Window.partitionBy("query_id", "node_id").orderBy(F.desc("score"), "doc_id", "seq")) + offset
    return hits.withColumn("_part", _weight(weights) / (k + rank)).groupBy("query_id", "doc_id").agg(F.round(F.sum("_part"), 9).alias("score"), F.count(F.lit(1)).alias("nodes"))


def rrf_of_one_list(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """One concatenated list in the order of ``seq``: equal scores, so a document has the rank of its last place."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("seq"))
    return hits.withColumn("_p", place).groupBy("query_id", "doc_id").agg(F.round(1 / (k + F.max("_p")), 9).alias("score"))


def weighted_score(hits: DataFrame, weights: Mapping[str, float] | None = None, nodes: int = 2) -> DataFrame:
    """First s w, then at each repeat (acc + s w) / (n + 1), n the sources so far, in the order of ``seq``."""
    part = F.col("score") * _weight(weights, 1.0 / nodes)
    lists = hits.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", part.alias("s")))).alias("l"))  # a document's nodes
    start = F.struct(F.lit(0.0).alias("acc"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(F.when(a["n"] == 0, x["s"]).otherwise((a["acc"] + x["s"]) / (a["n"] + 1)).alias("acc"), (a["n"] + 1).alias("n"))
    return lists.select("query_id", "doc_id", F.round(F.aggregate("l", start, step, lambda a: a["acc"]), 6).alias("score"))


def relative_score(hits: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Scores scaled to 0..1 within each node, weighted and added; a node of equal scores gives 0."""
    w = Window.partitionBy("query_id", "node_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = (F.col("score") - low) / F.when(high > low, high - low).otherwise(F.lit(1.0))
    return hits.withColumn("_s", scaled * _weight(weights)).groupBy("query_id", "doc_id").agg(F.round(F.sum("_s"), 6).alias("score"))


def dedup(hits: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """One row a key: score by ``first``, ``highest``, ``average`` (running, of pairs) or ``latest``; with its nodes and count."""
    lists = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "node_id", "doc_id", "score"))).alias("l"))
    first = F.get("l", F.lit(0))
    score = {
        "first": first["score"],
        "highest": F.array_max(F.transform("l", lambda x: x["score"])),
        "latest": F.element_at("l", -1)["score"],
        "average": F.aggregate(F.slice("l", F.lit(2), F.size("l")), first["score"], lambda a, x: (a + x["score"]) / 2),
    }[policy]
    extra = [] if "doc_id" in keys else [first["doc_id"].alias("doc_id")]
    return lists.select(*keys, *extra, F.round(score, 6).alias("score"), F.array_join(F.array_sort(F.array_distinct(F.transform("l", lambda x: x["node_id"]))), ",").alias("nodes"), F.size("l").cast("bigint").alias("occurrences"))


def dedup_content(hits: DataFrame, content: str, policy: str = "first") -> DataFrame:
    """One row for each document of a query, where a hit counts for the document whose hit had its content first, in the order of ``seq``.

    So hits merge by equal content, and by a document id seen before with other content, as when hits come in one by one.
    """
    owner = hits.groupBy("query_id", F.col(content).alias("_c")).agg(F.min_by("doc_id", "seq").alias("_owner"))
    named = hits.alias("h").join(owner.alias("o"), F.col("h.query_id").eqNullSafe(F.col("o.query_id")) & F.col(f"h.{content}").eqNullSafe(F.col("o._c")))
    return dedup(named.select("h.query_id", F.col("o._owner").alias("doc_id"), "h.node_id", "h.score", "h.seq"), ["query_id", "doc_id"], policy)


def first_of(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    ranked = df.withColumns(named).withColumn("_n", F.row_number().over(Window.partitionBy(*named).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n", *named)
