"""Similarity as of a time: each question against the newest entries that were there before it.

A cache of bounded size that drops its oldest entry holds, at any time, the newest ``capacity`` entries written before; a time
to live takes away the older of these. So a question's candidates are entries at neighbouring places in time: entries are cut into
blocks of places, a question goes to the one or two blocks that its candidates lie in, and blocks meet as matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import running_total
from .vectors import doubles, norm

QUESTIONS = 256


def _blocks(rows: DataFrame, prefix: str, size: int) -> DataFrame:
    """Rows of up to ``size`` rows of one block: ids, places, times and vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for block, all_ in batch.groupby("block", sort=False):
                for at in range(0, len(all_), size):
                    part = all_.iloc[at : at + size]
                    out.append((block, part["id"].tolist(), part["place"].tolist(), part["at"].tolist(), np.stack(part["vector"]).tobytes()))
            yield pd.DataFrame(out, columns=["block", *(f"{prefix}_{c}" for c in ("ids", "places", "times", "rows"))])

    kinds = f"block bigint, {prefix}_ids array<bigint>, {prefix}_places array<bigint>, {prefix}_times array<double>, {prefix}_rows binary"
    return rows.repartition("block").sortWithinPartitions("block", "place", "id").select("block", "id", "place", "at", "vector").mapInPandas(run, kinds)


def asof_similar(entries: DataFrame, questions: DataFrame, threshold: float = 0.95, capacity: int = 500, ttl: float | None = None, size: int = 1024) -> DataFrame:
    """id, entry_id, cosine (6 digits) of the most similar entry of each question (id, at, vector), of those of the threshold or more.

    ``at`` is a time in seconds. Entries written at a question's time do not count as before it. Ties go to the newest entry.
    """
    size = max(size, capacity)
    unit = lambda df, kind: df.where(norm(F.col("vector")) > 0).select("id", F.col("at").cast("double").alias("at"), doubles(F.col("vector")).alias("vector"), F.lit(kind).alias("kind"))
    both = unit(entries, 1).unionByName(unit(questions, 0)).withColumn("all", F.lit(0))
    # questions first at a time, so that its entries are not before them
    placed = running_total(both, ["all"], ["at", "kind", "id"], F.col("kind").cast("bigint"), "place").drop("all")
    held = _blocks(placed.where("kind = 1").withColumn("block", F.floor(F.col("place") / size)), "e", size)
    last, first = F.floor((F.col("place") - 1) / size), F.floor(F.greatest(F.col("place") - capacity, F.lit(0)) / size)
    asked = _blocks(placed.where("kind = 0 and place > 0").withColumn("block", F.explode(F.sequence(first, last))), "q", QUESTIONS)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                e, q = (np.frombuffer(r).reshape(len(i), -1) for r, i in ((row.e_rows, row.e_ids), (row.q_rows, row.q_ids)))
                cosine = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (e / np.linalg.norm(e, axis=1, keepdims=True)).T, 6)
                place, upto = np.asarray(row.e_places), np.asarray(row.q_places)[:, None]
                live = (place < upto) & (place >= upto - capacity)
                if ttl is not None:
                    live &= np.asarray(row.e_times) > np.asarray(row.q_times)[:, None] - ttl
                fit = np.where(live & (cosine >= threshold), cosine, -2.0)
                best = fit.shape[1] - 1 - fit[:, ::-1].argmax(1)  # of equals, the newest
                for i in np.flatnonzero(fit.max(1) > -2):
                    out.append((row.q_ids[i], row.e_ids[best[i]], float(fit[i, best[i]]), int(place[best[i]])))
            yield pd.DataFrame(out, columns=["id", "entry_id", "cosine", "place"])

    found = asked.join(held, "block").mapInPandas(meet, "id bigint, entry_id bigint, cosine double, place bigint")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), F.desc("place")))
    return found.withColumn("_r", rank).where("_r = 1").select("id", "entry_id", "cosine")
