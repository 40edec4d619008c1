"""A stored BM25 index: batches of documents are merged once each, queries read only the parts of the lists they need.

A batch is a segment of the store: postings (a term's documents and their lengths, in parts by the term's hash) and document
counts as deltas, which add up over segments. Its texts are split once. What is
shuffled, sorted and compacted are rows of a term and its documents among some thousands, not rows of a term and a document; a term
has a row for each such group it was met in, so no row grows with the index. The group's documents themselves are a row without
a term, in a part of their own. The log entry of a batch holds its number of documents and tokens. Merging a batch that the
log knows changes nothing, so a batch can be repeated after any failure; documents that the index holds already, and copies
within a batch, are left out. Compaction writes all segments as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import index_tokens
from ..sources.stores import Store
from .retrieval import EPSILON, K1, B, postings, topk

PARTS = 64
#: Postings that a task turns from documents to terms at a time.
HELD = 1 << 21
#: Rows of lists that a task hands on at a time.
ROWS = 1 << 14
_LISTS = "term string, doc_ids array<bigint>, dls array<int>, hashes array<string>"
_POSTINGS, _COUNTS, _DOCS = f"{_LISTS}, part int", "term string, df bigint", "doc_id bigint, hash string, dl int"


def _part(term: Column) -> Column:
    return F.when(term.isNull(), F.lit(PARTS)).otherwise(F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int"))


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, hash, terms to rows term, doc_ids, dls: a row for each term of about ``HELD`` postings, and before them one without a term, of all documents."""

    def lists(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        doc_id, hashes, terms = (rows.column(c).combine_chunks() for c in ("doc_id", "hash", "terms"))
        dl = terms.value_lengths().fill_null(0)
        words = terms.flatten().dictionary_encode()
        there = words.indices.is_valid().to_numpy(zero_copy_only=False)
        codes = words.indices.drop_null().to_numpy()
        row = np.repeat(np.arange(len(rows), dtype=np.int32), dl.to_numpy())[there][np.argsort(codes, kind="stable")]
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(words.dictionary)))]).astype(np.int32))
        ids, lengths = (pa.ListArray.from_arrays(ends, pa.array(c.to_numpy()[row])) for c in (doc_id, dl))
        yield batch([None], *(pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), c) for c in (doc_id, dl, hashes.cast(pa.string()))))
        out = batch(words.dictionary, ids, lengths, pa.nulls(len(words.dictionary), pa.list_(pa.string())))
        for at in range(0, len(out), ROWS):
            yield out.slice(at, ROWS)

    def batch(terms: list | pa.Array, *columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()) if isinstance(terms, list) else terms.cast(pa.string()), *columns], names=["term", "doc_ids", "dls", "hashes"])

    held, n = [], 0
    for some in batches:
        held.append(some)
        n += len(some.column(2).flatten())
        if n >= HELD:
            yield from lists(held)
            held, n = [], 0
    if held:
        yield from lists(held)


class Bm25Index:
    """``tokens`` makes the list of a text's distinct terms, the same for documents and queries."""

    def __init__(self, spark: SparkSession, path: str, tokens: Callable[[Column], Column] = index_tokens):
        self.store, self.spark, self.tokens = Store(spark, path), spark, tokens

    def add(self, docs: DataFrame, batch: str, dedup: bool = True) -> dict[str, int]:
        """Merge the rows doc_id, text as a batch: how many were indexed, and how many left out as copies or as known."""
        if self.store.known(batch):
            return {"indexed": 0, "duplicates": 0, "known": 1}
        folder = self.store.folder()
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
        if dedup:  # the first of equal texts, here and in the index
            rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("hash").orderBy("doc_id"))).where("_k = 1").drop("_k")
            rows = rows.join(self.documents().select("hash"), "hash", "left_anti")
        rows = rows.join(self.documents().select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"])
        lists = rows.select("doc_id", "hash", self.tokens(F.col("text")).alias("terms")).mapInArrow(_inverted, _LISTS)
        held = self._write_lists(lists.withColumn("part", _part(F.col("term"))), folder)
        self.store.write(held.where(F.col("part") < PARTS).groupBy("term").agg(F.sum(F.size("doc_ids")).alias("df")), folder, "counts")
        here = held.where(F.col("part") == PARTS).select(F.inline(F.arrays_zip(*[F.col(c).alias(name) for c, name in (("doc_ids", "doc_id"), ("hashes", "hash"), ("dls", "dl"))])))
        done = self.store.write(here, folder, "documents")
        n, total = done.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        self.store.commit(batch, "add", folder, figures={"documents": n, "tokens": total})
        return {"indexed": n, "duplicates": docs.count() - n, "known": 0}

    def _write_lists(self, lists: DataFrame, folder: str) -> DataFrame:
        return self.store.write(lists.repartition("part").sortWithinPartitions("part", "term").select("term", "doc_ids", "dls", "hashes", "part"), folder, "postings", "part")

    def documents(self) -> DataFrame:
        return self.store.part("documents", _DOCS)

    def compact(self) -> None:
        """One segment in place of all there are; readers that began before go on with theirs until ``store.purge``."""
        entries = self.store.live()
        if len(entries) < 2:
            return
        folder = self.store.folder()
        self._write_lists(self.store.part("postings", _POSTINGS), folder)
        self.store.write(self._counts(), folder, "counts")
        self.store.write(self.documents(), folder, "documents")
        covers = sorted({c for r in entries for c in (r["entry"], *r["covers"])})
        figures = {name: sum(r["figures"][name] for r in entries) for name in ("documents", "tokens")}
        self.store.commit(folder, "compact", folder, covers, figures)

    def _counts(self) -> DataFrame:
        return self.store.part("counts", _COUNTS).groupBy("term").agg(F.sum("df").alias("df"))

    def idf(self) -> DataFrame:
        """term, df, idf; a negative idf becomes a quarter of the mean over all terms."""
        n = sum(r["figures"]["documents"] for r in self.store.live())
        raw = self._counts().withColumn("idf", F.log(F.lit(n + 0.5) - F.col("df")) - F.log(F.col("df") + F.lit(0.5)))
        mean = raw.agg(F.coalesce(F.avg("idf"), F.lit(0.0)).alias("_mean"))  # one row
        return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("idf") < 0, F.lit(EPSILON) * F.col("_mean")).otherwise(F.col("idf")).alias("idf"))

    def search(self, queries: DataFrame, k: int = 25) -> DataFrame:
        """query_id, doc_id, score (6 digits), rank. Only the parts that hold the queries' terms are read."""
        entries = self.store.live()
        n, total = (sum(r["figures"][name] for r in entries) for name in ("documents", "tokens"))
        average = total / n if n and total else 1.0
        wanted = postings(queries, "query_id", tokens=self.tokens).select("query_id", "term", _part(F.col("term")).alias("part"))
        parts = sorted(r["part"] for r in wanted.select("part").distinct().collect())  # PARTS numbers at most
        lists = self.store.part("postings", _POSTINGS).where(F.col("part").isin(parts)).select("term", "doc_ids", "dls")
        lists = lists.join(wanted.select("term").distinct(), "term", "left_semi")  # before any of them is shuffled, where the terms are few
        score = F.col("idf") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / F.lit(average)))
        weighed = wanted.drop("part").join(self.idf(), "term")
        met = lists.join(weighed, "term").select("query_id", "idf", F.inline(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("dls").alias("dl"))))
        return topk(met.groupBy("query_id", "doc_id").agg(F.round(F.sum(score), 6).alias("score")), ["query_id"], k)
