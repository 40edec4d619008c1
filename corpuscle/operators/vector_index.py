"""A stored inverted file of vectors: centres, 8-bit codes by cell, and exact vectors to rank anew.

Centres are fitted on a bounded sample chosen by a hash of the key; every vector is assigned to the nearest and stored in its cell's folder, in blocks
of codes with a scale and an offset each, and as it is. A query reads the cells of the centres nearest to it and no other
folder: blocks of queries meet blocks of codes as matrices, the best by codes are looked up and ranked by exact inner products.
Batches of queries share one index, and batches of vectors can be added to it: they go to the cells that are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stores import Store
from .vectors import dot, doubles, norm

BLOCK, QUERIES = 1024, 256
#: Vectors that centres are fitted on, and cells, at most.
SAMPLE, MOST_CELLS = 50_000, 4096
#: Parts of a cell's rows while they are written, so that a large cell is many tasks' work.
SALTS = 16
_CODES = "ids array<bigint>, codes binary, scales binary, lows binary, cell int"
_ROWS = "id bigint, vector array<double>, cell int"
_CENTRES = "cell int, centre array<double>"


def _fit(rows: DataFrame, cells: int | None, sample: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = rows.count()
    cells = min(MOST_CELLS, cells or max(1, int(4 * np.sqrt(n))))
    part = min(1.0, sample / max(1, n))
    few = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(part * (1 << 30)))
    if cells < 2 or n < 2:
        total = few.select(F.posexplode("vector")).groupBy("pos").agg(F.avg("col").alias("x")).orderBy("pos").collect()
        return np.array([[r["x"] for r in total]])
    fitted = KMeans(k=cells, seed=seed, maxIter=8, initMode="random").fit(few.select(array_to_vector("vector").alias("features")))
    return np.unique(np.array(fitted.clusterCenters()), axis=0)


class CellIndex:
    """``probes`` cells are read for a query, and ``expand`` times k rows by codes are ranked by exact products."""

    def __init__(self, spark: SparkSession, path: str):
        self.store, self.spark = Store(spark, path), spark

    def build(self, corpus: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 7, batch: str = "first") -> None:
        """Fit the centres and store all vectors; nothing is done if the index is there."""
        if self.store.known("centres"):
            return
        rows = self._rows(corpus, key, vector)
        centres = _fit(rows, cells, sample, seed)
        folder = self.store.folder()
        self.store.write(self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], _CENTRES).coalesce(1), folder, "centres")
        for part, schema in (("codes", _CODES), ("rows", _ROWS)):
            self.store.write(self.spark.createDataFrame([], schema), folder, part)
        self.store.commit("centres", "centres", folder, figures={"cells": len(centres)})
        self.add(corpus, key, vector, batch)

    def _rows(self, df: DataFrame, key: str, vector: str) -> DataFrame:
        return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (norm(F.col(vector)) >= 0)).select(F.col(key).cast("bigint").alias("id"), doubles(F.col(vector)).alias("vector"))

    def centres(self) -> np.ndarray:
        entry = next(r for r in self.store.live() if r["kind"] == "centres")
        rows = self.spark.read.schema(_CENTRES).parquet(f"{self.store.path}/{entry['folder']}/centres").orderBy("cell").collect()  # MOST_CELLS at most
        return np.array([r["centre"] for r in rows])

    def add(self, rows: DataFrame, key: str, vector: str, batch: str) -> None:
        """Store a batch of vectors in the cells there are; a batch that is known changes nothing."""
        if self.store.known(batch):
            return
        centres = self.centres()
        away = (centres**2).sum(1)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                if len(part):
                    v = np.stack(part["vector"])
                    yield part.assign(cell=(away - 2 * v @ centres.T).argmin(1).astype(np.int32))

        folder = self.store.folder()
        placed = self._rows(rows, key, vector).mapInPandas(place, _ROWS)
        placed = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("cell", "id")
        held = self.store.write(placed, folder, "rows", "cell")
        coded = held.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("cell", "id").select("id", "vector", "cell").mapInPandas(_code, _CODES)
        self.store.write(coded, folder, "codes", "cell")
        self.store.commit(batch, "add", folder, figures={"vectors": held.count()})

    def probed(self, queries: DataFrame, key: str, vector: str, probes: int) -> tuple[DataFrame, list[int]]:
        """(query, vector, cell) for the cells nearest to each query, and all these cells."""
        centres = self.centres()
        away = (centres**2).sum(1)

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                if len(part):
                    v = np.stack(part["vector"])
                    first = np.argsort(away - 2 * v @ centres.T, axis=1)[:, :probes]
                    yield part.assign(cells=[r.tolist() for r in first.astype(np.int32)])

        asked = self._rows(queries, key, vector).mapInPandas(nearest, "id bigint, vector array<double>, cells array<int>")
        asked = asked.select(F.col("id").alias("query_id"), "vector", F.explode("cells").alias("cell"))
        return asked, sorted(r["cell"] for r in asked.select("cell").distinct().collect())

    def search(self, queries: DataFrame, key: str, vector: str, k: int = 10, probes: int = 8, expand: int = 4) -> DataFrame:
        """query_id, doc_id, score (6 digits), rank."""
        asked, cells = self.probed(queries, key, vector, probes)
        blocks = asked.repartition("cell").sortWithinPartitions("cell", "query_id").mapInPandas(_question, "cell int, asked array<bigint>, questions binary")
        codes = self.store.part("codes", _CODES).where(F.col("cell").isin(cells))
        rough = codes.join(blocks, "cell").mapInPandas(_rough(k * expand), "query_id bigint, id bigint, cell int, rough double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rough"), "id"))
        rough = rough.withColumn("_r", rank).where(F.col("_r") <= k * expand).select("query_id", "id", "cell")
        exact = self.store.part("rows", _ROWS).where(F.col("cell").isin(cells)).withColumnRenamed("vector", "_v")
        asked = asked.select("query_id", "vector").dropDuplicates(["query_id"])
        scored = exact.join(rough, ["cell", "id"]).join(asked, "query_id").select("query_id", F.col("id").alias("doc_id"), F.round(dot(F.col("vector"), F.col("_v")), 6).alias("score"))
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)

    def rows(self) -> DataFrame:
        return self.store.part("rows", _ROWS)


def _cell_runs(part: pd.DataFrame, size: int) -> Iterator[tuple[int, pd.DataFrame]]:
    for cell, rows in part.groupby("cell", sort=False):
        for at in range(0, len(rows), size):
            yield int(cell), rows.iloc[at : at + size]


def _code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        out = []
        for cell, rows in _cell_runs(part, BLOCK):
            v = np.stack(rows["vector"])
            low, high = v.min(1), v.max(1)
            scale = np.where(high > low, (high - low) / 255, 1.0)
            codes = np.rint((v - low[:, None]) / scale[:, None]).astype(np.uint8)
            out.append((rows["id"].tolist(), codes.tobytes(), scale.tobytes(), low.tobytes(), cell))
        yield pd.DataFrame(out, columns=["ids", "codes", "scales", "lows", "cell"])


def _question(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        out = [(cell, rows["query_id"].tolist(), np.stack(rows["vector"]).tobytes()) for cell, rows in _cell_runs(part, QUERIES)]
        yield pd.DataFrame(out, columns=["cell", "asked", "questions"])


def _rough(k: int):
    """The k best rows of each block for each query, by codes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for row in part.itertuples(index=False):
                ids, asked = np.asarray(row.ids), np.asarray(row.asked)
                q = np.frombuffer(row.questions).reshape(len(asked), -1)
                codes = np.frombuffer(row.codes, np.uint8).reshape(len(ids), -1).astype(np.float64)
                scores = (q @ codes.T) * np.frombuffer(row.scales) + q.sum(1, keepdims=True) * np.frombuffer(row.lows)
                best = np.argpartition(-scores, min(k, len(ids)) - 1, axis=1)[:, :k]
                n = best.shape[1]
                out.append(pd.DataFrame({"query_id": np.repeat(asked, n), "id": ids[best].ravel(), "cell": np.int32(row.cell), "rough": np.take_along_axis(scores, best, 1).ravel()}))
            if out:
                yield pd.concat(out)

    return run
