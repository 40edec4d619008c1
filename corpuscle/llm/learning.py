"""Bounded training samples and plain logistic regression, shared by the learned operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of each label at most in a training sample.
PER_LABEL = 1500


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labelled: DataFrame, label: str, per_label: int = PER_LABEL) -> pd.DataFrame:
    """At most ``per_label`` texts of each label, chosen by a hash of doc_id: columns doc_id, label, text; in a fixed order.

    ``labelled`` has doc_id and the label, of which there are few kinds; null labels and held-out rows are left out. Texts are
    whole. The ids are a bounded number, so they may be broadcast.
    """
    usable = labelled.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", label)
    counts = usable.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # about twice as many as are wanted have so small a hash; only those are ranked
    unit = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    likely = usable.join(F.broadcast(counts), label).where(unit * F.col("_n") <= 2 * per_label + 50).select("doc_id", label).distinct()
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)), "doc_id"))
    chosen = likely.withColumn("_rank", rank).where(F.col("_rank") <= per_label)
    ids = [(int(r["doc_id"]), r[label]) for r in chosen.collect()]  # bounded: per_label ids of each label
    if not ids:
        return pd.DataFrame({"doc_id": [], label: [], "text": []})
    few = docs.sparkSession.createDataFrame(ids, schema=f"doc_id bigint, {label} {dict(labelled.dtypes)[label]}")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = texts.join(F.broadcast(few), "doc_id").select("doc_id", label, "text").toPandas()
    return got.sort_values(["doc_id", "text"], kind="stable").drop_duplicates("doc_id").reset_index(drop=True)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features by targets) and biases of one logistic regression for each column of y in {0, 1}, by Adam on all rows."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    share = (weight / weight.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        e = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * share
        g, gb = x.T @ e + np.float32(l2) * w, e.sum(0)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        b -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    return w, b
