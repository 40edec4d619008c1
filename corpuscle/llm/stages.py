"""The operators as pipeline stages: (spark, docs, sf_dir) to a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, ngram_join, packing, pii, quality_cnn
from .common import read, shared_folder, small_batches


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder in the one that shared_folder names.

    What is written there feeds a result that is still lazy, so it stays, as checkpoints do.
    """
    small_batches(spark)
    yield f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the byte network accepts. It learns from the labels of the documents it is given."""
    small_batches(spark)
    return quality_cnn.keep_good(docs, quality_cnn.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the first by doc_id; of rows that repeat a doc_id of a group, one."""
    small_batches(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind in brackets and n_chars counted anew."""
    small_batches(spark)
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it."""
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows; doc_id, start, ids, doc_tokens, sequence_id, offset."""
    small_batches(spark)
    return packing.pack(docs).withColumn("length", (F.octet_length("ids") / 4).cast("bigint"))
