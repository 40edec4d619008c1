"""The corpus pipeline: quality, near duplicates, personal data, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents; the last returns the packed pieces. Near duplicates are judged by five-word shingles at 0.8; the row of the smallest
doc_id of each group stays. The mixture repeats rows that are due more than once and drops those not taken. The stages are
tested against brute force, since SQL expresses neither the classifier nor the tokenizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm import stages

STAGES = [
    ("quality_classifier", stages.quality),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("pii", stages.personal_data),
    ("mixing", stages.mixture),
    ("packing", stages.packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with stages.scratch(spark) as folder:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            path = f"{folder}/{k}_{name}"
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
