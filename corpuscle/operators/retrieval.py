"""Sparse retrieval, candidate limits and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import index_tokens
from ..sources.snapshots import scratch
from ..sources.tables import spread

K1, B, EPSILON = 1.5, 0.75, 0.25


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text", tokens: Callable[[Column], Column] = index_tokens) -> DataFrame:
    """key, dl, terms: each document's distinct terms, written to the shared folder, since an index is read several times and splitting texts is its main cost.

    For an index that outlives a query, see ``bm25_index``.
    """
    rows = spread(docs.select(key, text)).select(key, tokens(F.col(text)).alias("terms")).select(key, F.size("terms").alias("dl"), "terms")
    path = scratch(docs.sparkSession, "terms")
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", tokens: Callable[[Column], Column] = index_tokens) -> DataFrame:
    """key, dl, term: a row for each distinct term of each document (so a term's frequency is 1)."""
    # the outer form keeps the optimizer from testing the token list, that is from splitting each text again, before it
    return docs.select(key, tokens(F.col(text)).alias("_t")).select(key, F.size("_t").alias("dl"), F.explode_outer("_t").alias("term")).where("term is not null")


def idf_table(index: DataFrame) -> DataFrame:
    """term, df, idf of rows of dl, terms; a negative idf becomes a quarter of the mean over all terms."""
    counts = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = index.agg(F.count(F.lit(1)).alias("_n"))  # one row, as is the mean
    raw = counts.crossJoin(F.broadcast(n)).withColumn("idf", F.log(F.col("_n") + F.lit(0.5) - F.col("df")) - F.log(F.col("df") + F.lit(0.5)))
    mean = raw.agg(F.coalesce(F.avg("idf"), F.lit(0.0)).alias("_mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("idf") < 0, F.lit(EPSILON) * F.col("_mean")).otherwise(F.col("idf")).alias("idf"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 25) -> DataFrame:
    """query_id, doc_id, score (6 digits), rank of the best documents of each query, of those that share a term with it.

    The texts are split and written at once; the index's figures are one-row tables of the plan that reads them.
    """
    index = tokenized(docs)
    size = index.agg(F.avg("dl").alias("_average"))
    wanted = postings(queries, "query_id").select("query_id", "term")
    weighed = wanted.join(idf_table(index), "term")
    # the index's lists are cut to the queries' terms before anything else is joined to them
    lists = index.select("doc_id", "dl", F.explode("terms").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(size))
    average = F.when(F.col("_average") > 0, F.col("_average")).otherwise(F.lit(1.0))
    score = F.col("idf") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / average))
    scores = lists.join(weighed, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(score), 6).alias("score"))
    return topk(scores, ["query_id"], k)


def topk(scores: DataFrame, keys: list[str], k: int, tie: str = "doc_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), tie))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def pseudo_scores(hits: DataFrame) -> DataFrame:
    """Scores by rank where a source gives none: 1, 0.9, ... and no less than 0."""
    return hits.withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - 0.1 * (F.col("rank") - 1)), 6))


def dynamic_limit(hits: DataFrame, keys: list[str], gap: float = 0.5, few: int = 10) -> DataFrame:
    """Only ``few`` candidates where the first's normalised score leads the fifth's by more than ``gap``."""
    w = Window.partitionBy(*keys)
    first, fifth = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(w), F.max(F.when(F.col("rank") == 5, F.col("score"))).over(w)
    return hits.withColumn("_cut", F.coalesce((first - fifth) / F.when(first != 0, first) > gap, F.lit(False))).where(~F.col("_cut") | (F.col("rank") <= few)).drop("_cut")


def overlap_score(query: Column, text: Column) -> Column:
    """Offline stand-in for a cross-encoder: the share of the query's terms that the text has."""
    q = index_tokens(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, index_tokens(text))) / F.size(q))


def rerank(hits: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None, k: int, bypass: float = 0.95, lead: float = 0.3) -> DataFrame:
    """Route each query: a clear winner or a single hit keeps its order, others are scored anew by ``scorer``; best k.

    ``hits`` has query_id, doc_id, score, rank and what the scorer needs; the scorer adds rerank_score.
    """
    w = Window.partitionBy("query_id")
    first = F.max("score").over(w)
    second = F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))).over(w), F.lit(0.0))
    routed = hits.withColumn("route", F.when(F.count(F.lit(1)).over(w) == 1, "single").when((first >= bypass) & (first - second >= lead), "early").otherwise("semantic"))
    scored = scorer(routed) if scorer else routed.withColumn("rerank_score", F.col("score"))
    final = F.when(F.col("route") == "semantic", F.round("rerank_score", 6)).otherwise(F.col("score"))
    return topk(scored.withColumns({"old_rank": F.col("rank"), "score": final}), ["query_id"], k)


def diversity(hits: DataFrame, terms: str, weight: float = 0.7, penalty: float = 0.1) -> DataFrame:
    """Scores lowered by what the hits ranked before have in common with a hit: w s + (1 - w)(1 - sum of Jaccard * penalty)."""
    before = hits.select(F.col("query_id"), F.col("rank").alias("_r"), F.col(terms).alias("_t"))
    union = F.size(F.array_union(terms, "_t"))
    jaccard = F.when(union > 0, F.size(F.array_intersect(terms, "_t")) / union).otherwise(F.lit(0.0))
    pairs = hits.join(before, "query_id", "left").withColumn("_j", F.when(F.col("_r") < F.col("rank"), jaccard).otherwise(F.lit(0.0)))
    shared = pairs.groupBy("query_id", "doc_id", "score", "rank").agg(F.sum("_j").alias("_sum"))  # a query's few hits
    return shared.withColumn("score", F.round(weight * F.col("score") + (1 - weight) * (1 - F.col("_sum") * penalty), 6)).drop("_sum")
