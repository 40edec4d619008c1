"""Stored indexes (inventory R, V, P, D): each query writes one in the shared folder, adds to it in batches, and asks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digests, vectors
from ..operators.asof import asof_similar
from ..operators.bm25_index import Bm25Index
from ..operators.metadata_index import MetadataIndex
from ..operators.readthrough import ReadThrough
from ..operators.vector_index import CellIndex
from ..sources.snapshots import scratch
from ..sources.stores import Store
from ..sources.tables import table
from .registry import REGISTRY
from .retrieval_queries import _BM25, _INDEX, K, _queries

add = REGISTRY.add


def _stored_bm25(spark: SparkSession, sf_dir: str) -> Bm25Index:
    """The documents in three batches, one of them sent twice, written as one segment at the end."""
    index = Bm25Index(spark, scratch(spark, "bm25"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for batch in (0, 1, 1, 2):
        index.add(docs.where(F.pmod("doc_id", F.lit(3)) == batch), f"batch-{batch}", dedup=False)
    index.compact()
    return index


@add("r1_stored_counts", f"WITH {_INDEX} SELECT substr(term, 1, 1) AS letter, count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings, round(sum(idf), 4) AS idf FROM i0 GROUP BY 1")
def stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index by the first letter of terms; idf before negative ones are replaced."""
    index = _stored_bm25(spark, sf_dir)
    n = sum(r["figures"]["documents"] for r in index.store.live())
    raw = F.log(F.lit(n + 0.5) - F.col("df")) - F.log(F.col("df") + F.lit(0.5))
    return index.idf().groupBy(F.substring("term", 1, 1).alias("letter")).agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"), F.round(F.sum(raw), 4).alias("idf"))


@add("r2_stored_bm25_topk", f"WITH {_BM25} SELECT * FROM bm")
def stored_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_bm25(spark, sf_dir).search(_queries(spark, sf_dir), K)


@add("d5_batch_indexing", "SELECT 'batch-' || (doc_id % 4) AS batch, count(*) AS indexed FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id % 4, doc_id) AS k FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)) WHERE k = 1 GROUP BY 1")
def batch_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each batch adds to the index when copies, of its own and of earlier batches, are left out."""
    index = Bm25Index(spark, scratch(spark, "bm25"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for batch in range(4):
        index.add(docs.where(F.pmod("doc_id", F.lit(4)) == batch), f"batch-{batch}")
    rows = [(r["entry"], int(r["figures"]["documents"])) for r in index.store.live() if r["figures"]["documents"]]
    return spark.createDataFrame(rows, "batch string, indexed bigint")


def _stored_cells(spark: SparkSession, sf_dir: str) -> tuple[CellIndex, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    index = CellIndex(spark, scratch(spark, "cells"))
    index.build(e.where("vec_id % 4 <> 3"), "vec_id", "embedding", cells=32)
    index.add(e.where("vec_id % 4 = 3"), "vec_id", "embedding", "second")
    return index, e


@add("v7_stored_cells_topk")
def stored_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of queries by one stored index."""
    index, e = _stored_cells(spark, sf_dir)
    return index.search(e.where("vec_id % 40 = 0"), "vec_id", "embedding", 10, PROBES).unionByName(index.search(e.where("vec_id % 40 = 20"), "vec_id", "embedding", 10, PROBES))


#: Cells of 32 that a query reads: the tables' vectors have no clusters, so that neighbours lie in many cells.
PROBES = 24


@add("v7_stored_cells_recall", "SELECT count(*) AS queries, true AS recalled FROM embeddings WHERE vec_id % 20 = 0")
def stored_cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the stored index finds nine tenths of the ten best that brute force finds."""
    index, e = _stored_cells(spark, sf_dir)
    asked = e.where("vec_id % 20 = 0")
    found = index.search(asked, "vec_id", "embedding", 10, PROBES).select("query_id", "doc_id", F.lit(1).alias("hit"))
    true = vectors.dense_topk(e, asked, "vec_id", "embedding", 10).select("query_id", "doc_id")
    return true.join(found, ["query_id", "doc_id"], "left").agg(F.count_distinct("query_id").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recalled"))


def _metadata(spark: SparkSession, sf_dir: str) -> MetadataIndex:
    index = MetadataIndex(spark, scratch(spark, "metadata"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.floor(F.col("n_chars") / 1000).alias("thousands"), F.split(F.substring("text", 1, 12), " ").alias("begins"))
    for half in (0, 1):
        index.build(docs.where(F.col("doc_id") % 2 == half), "doc_id", ["lang", "source", "thousands", "begins"], f"half-{half}")
    return index


@add("p9_metadata_search", "SELECT doc_id AS id FROM documents WHERE lang = 'en' AND source = (SELECT min(source) FROM documents)")
def metadata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    return _metadata(spark, sf_dir).search({"lang": "en", "source": source})


@add(
    "p9_metadata_stats",
    """WITH v AS (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'thousands', CAST(CAST(floor(n_chars / 1000) AS BIGINT) AS VARCHAR) FROM documents
    UNION ALL SELECT 'begins', array_to_string(string_split(substr(text, 1, 12), ' '), chr(1)) FROM documents) SELECT field, count(DISTINCT value) AS n_values, count(*) AS n_entries FROM v WHERE value IS NOT NULL GROUP BY field""",
)
def metadata_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metadata(spark, sf_dir).stats()


@add(
    "p9_metadata_vectors",
    """SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND c.label = 3 AND c.vec_id % 2 = 1)) WHERE rank <= 5""",
)
def metadata_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search among the rows of two metadata values."""
    e = table(spark, sf_dir, "embeddings")
    index = MetadataIndex(spark, scratch(spark, "metadata"))
    index.build(e.withColumn("odd", F.col("vec_id") % 2 == 1), "vec_id", ["label", "odd"])
    return index.search_vectors(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), {"label": "3", "odd": "true"}, 5)


@add(
    "v14_optimised_index",
    """WITH n AS (SELECT b.vec_id FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.4), k AS (SELECT * FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n))
    SELECT CAST(label AS VARCHAR) AS value, count(*) AS rows, CAST(sum(len(embedding) + 16) AS BIGINT) AS code_bytes, CAST(sum(4 * len(embedding)) AS BIGINT) AS float_bytes FROM k GROUP BY label""",
)
def optimised_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates pruned, the rest as 8-bit codes, and its metadata indexed: sizes by metadata value."""
    kept = vectors.prune(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.4)
    coded = kept.select("vec_id", "label", vectors.quantise(F.col("embedding"), 255).alias("q"))
    index = MetadataIndex(spark, scratch(spark, "metadata"))
    index.build(coded, "vec_id", ["label"])
    sized = coded.select(F.col("vec_id").alias("id"), F.size("q.codes").cast("bigint").alias("n"))
    return index.entries().join(sized, "id").groupBy("value").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("n") + 16).alias("code_bytes"), F.sum(4 * F.col("n")).alias("float_bytes"))


@add("d6_read_through", "SELECT doc_id, sha256(coalesce(text, '')) IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 3 = 0) AS cached, true AS same FROM documents")
def read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents is embedded first; then all of them, of which only texts not seen are embedded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    through = ReadThrough(Store(spark, scratch(spark, "vectors")), vectors.hash_embed)
    through(docs.where("doc_id % 3 = 0"), "text", "v")
    found = through(docs, "text", "v").join(vectors.hash_embed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "w").select("doc_id", "w"), "doc_id")
    return found.select("doc_id", F.col("v_cached").alias("cached"), (F.col("v") == F.col("w")).alias("same"))


@add(
    "st11_semantic_cache_asof",
    """WITH e AS (SELECT vec_id AS id, vec_id::DOUBLE AS at, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS id, (vec_id + vec_id * 37 % 400)::DOUBLE + 0.5::DOUBLE AS at, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0),
    p AS (SELECT q.id, e.id AS entry_id, round(list_cosine_similarity(q.v, e.v), 6) AS cosine, row_number() OVER (PARTITION BY q.id ORDER BY e.at DESC) AS back, e.at > q.at - 150 AS live FROM q JOIN e ON e.at < q.at)
    SELECT id, entry_id, cosine FROM p WHERE back <= 200 AND live AND cosine >= 0.95 QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, back) = 1""",
)
def semantic_cache_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors enter the cache one a second and are asked for up to 400 seconds later: of 200 entries and 150 seconds, some are left."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").cast("double").alias("at"), F.col("embedding").alias("vector"))
    asked = e.where("id % 2 = 0").withColumn("at", (F.col("id") + F.col("id") * 37 % 400).cast("double") + 0.5)
    return asof_similar(e, asked, 0.95, capacity=200, ttl=150.0)


@add(
    "v18_range_tree",
    """SELECT label, CAST(floor(vec_id / 64) AS BIGINT) AS node, count(*) AS n, count(*) FILTER (vec_id % 101 <> 5) AS other_n FROM embeddings GROUP BY 1, 2 HAVING count(*) FILTER (vec_id % 101 = 5 OR vec_id % 97 = 3) > 0""",
)
def range_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of ids in which a copy of the vectors differs that lost some rows and has others changed."""
    e = table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 97 == 3, F.reverse("embedding")).otherwise(F.col("embedding"))
    trees = [digests.tree(rows, ["label"], "vec_id", ["embedding"], leaf=64) for rows in (e, e.where("vec_id % 101 <> 5").withColumn("embedding", changed))]
    return digests.differing(*trees, ["label"])


@add("v18_consistent_nodes", "SELECT label, count(*) FILTER (vec_id % 101 = 5) = 0 AS consistent FROM embeddings GROUP BY label")
def consistent_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    trees = [digests.tree(rows, ["label"], "vec_id", ["embedding"], leaf=64) for rows in (e, e.where("vec_id % 101 <> 5"))]
    return digests.consistent(*trees, ["label"])
