"""Proportional stratified interleaving into shards, with DataFrame functions only.

Rows of each source are ranked in a seeded shuffle; the rank over the source's count, (rank - 1/2) / n, is a position
between 0 and 1 at which every source is spread evenly; the rows sorted by it are cut into shards of equal counts. So each
shard holds every source in the proportion of the whole table, to within a row or two of each source.

Scale: no text is shuffled. Ranks come from running sums over buckets of the shuffle and of the position, so a source
with a third of the rows is ranked by as many tasks as it has buckets; the only single-task step sees one row per bucket.

Null doc_id or source: an id and a source of their own. Null text: size 16. Equal rows get different slots. Tables without
rows give no rows. Other columns are left alone and not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_sum, unit_hash

BUCKETS = 4096


def stratified_interleave(docs: DataFrame, shards: int = 40, seed: int = 17, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null) of every row of doc_id, text, source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col("source").alias("_source"),
        unit_hash(F.lit(seed), F.col("doc_id")).alias("_u"),
    )
    order = [F.col("_u"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    ranked = running_sum(rows, ["_source"], F.floor(F.col("_u") * buckets), order, F.lit(1), "_rank")
    placed = ranked.withColumn("_at", (F.col("_rank") - F.lit(0.5)) / F.col("_rank_total"))
    spread = running_sum(
        placed.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("_at") * buckets), [F.col("_at"), F.col("_source").asc_nulls_last()], F.lit(1), "_pos"
    )
    return spread.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.expr(f"cast((_pos - 1) * {shards} div _pos_total as int)").alias("shard"),
        F.expr(f"_pos - 1 - (((_pos - 1) * {shards} div _pos_total) * _pos_total + {shards - 1}) div {shards}").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
