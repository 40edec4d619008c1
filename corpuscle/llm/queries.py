"""The dealt operators applied to the driver's tables, one query each."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, fingerprint, language_id, mixing, negatives, ngram_join, packing, pii, quality_cnn, quality_rules, sharding, simhash, whitening
from .common import read, small_batches
from .sql import ORACLE_SQL  # noqa: F401


def op1_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql(f"select bigint(-1) conv_id, bigint(turn) turn, role, '{said}' text from values (0, 'user'), (1, 'assistant') as t(turn, role)")
    return chat_format.digests(turns.unionByName(own)).drop("n_examples")


def op2_locally_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(read(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_groups(read(spark, sf_dir, "documents"), n=3, percent=90)


def op4_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_interleave(read(spark, sf_dir, "documents"), shards=40)


def op5_threshold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op6_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    length, digest = (F.octet_length("ids") / 4).cast("bigint"), F.crc32("ids")
    return pieces.select("doc_id", "start", length.alias("length"), digest.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_cnn.classify(docs, quality_cnn.train(docs, read(spark, sf_dir, "labels")))


def op10_bootstrapped_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op11_subspace_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=4)


def op12_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(read(spark, sf_dir, "documents"))


def op13_summa_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, "vec_id", "embedding", label)



def _configured(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _configured(f) for f in (op1_prefix_target_chat, op2_locally_consistent_parsing, op3_ngram_jaccard_join, op4_stratified_interleave, op5_threshold_rules, op6_output_codes, op7_hilbert_packing, op8_pareto_mix, op9_byte_cnn, op10_bootstrapped_contexts, op11_subspace_whitening, op12_golay_simhash, op13_summa_negatives)
}

