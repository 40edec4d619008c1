"""Embedding whitening by matrix-free block subspace iteration.

The covariance of the vectors is never formed: each Spark pass reads the vectors once, centres them, and sums up X^T (X Q) for a
narrow block Q, a d x b matrix a task. The driver orthonormalises the sum (QR), solves the small problem within the block
(Rayleigh-Ritz), and goes on until the residuals |V q - e q| of all k components are at rounding level. Where the
spectrum is so flat that many passes would be due, the block doubles, up to the whole space, in which one pass is exact.

The fit list holds each distinct vector once, since copies would pull the components towards them; it is written once, with
two bytes an entry as a rule, and read by every pass. Sums are exact whole numbers; what reaches the driver are a few d x b blocks.

Vectors: entries times 256, floored. Rows whose vector is null or empty or has a null or non-finite entry take no part, nor
do those whose length is not the usual one (the most frequent, of equals the largest). Repeated rows each get a result. Components of no variance (rank
below k, one distinct vector) are left out, so a table may give no rows; so does an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, tidy
from .vector_rows import integer_rows, unpack, usual_dim, with_fields

#: Columns of the first block beyond k, and passes beyond which a block is rather doubled.
EXTRA, PATIENCE = 28, 8
#: Residuals of so much of the largest eigenvalue end the iteration; from LOOSE on, so does one that stops falling.
TIGHT, LOOSE = 1e-13, 1e-10
MOST_PASSES = 500
#: As many blocks of sums reach the driver at most.
REDUCERS = 32


@dataclass(frozen=True)
class Model:
    """Mean and components of a fit list: n vectors of sums S, eigenvectors (d x k) with values by falling value."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, bool]:
    """n x - S, exactly: as int64 where it fits (True), else as whole numbers of any size."""
    small = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62
    return (n * x - np.array(sums, np.int64), True) if small else (n * x.astype(object) - np.array(sums, object), False)


def _sums(dim: int) -> Callable:
    """(place, total): sums of every dimension, and at place dim of all squares, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, squares = [0] * dim, 0
        for batch in batches:
            x = unpack(batch.column(0), dim)
            big = int(np.abs(x).max(initial=0)) ** 2 * max(1, x.size) >= 1 << 62
            y = x.astype(object) if big else x
            totals = [a + int(b) for a, b in zip(totals, y.sum(0), strict=True)] if len(x) else totals
            squares += int((y * y).sum())
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(dim + 1), pa.int32()), "total": pa.array([str(t) for t in (*totals, squares)], pa.string())})

    return run


def _summed(partial: Callable, rows: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the arrays that ``partial`` makes of each task's vectors: of some tasks' in Spark first, then of what is left."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch.column(0))
        yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(shape), None
        for batch in batches:
            for task, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                first = task if first is None else first
                total += np.frombuffer(block.as_buffer()).reshape(shape)
        if first is not None:
            yield pa.RecordBatch.from_pydict({"task": pa.array([first], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    some = rows.mapInArrow(tidy(blocks), "task int, block binary")
    some = some.repartition(REDUCERS, "task").sortWithinPartitions("task").mapInArrow(tidy(add), "task int, block binary")
    return sum((np.frombuffer(r["block"]).reshape(shape) for r in sorted(some.collect())), np.zeros(shape))


def _times_covariance(fit: DataFrame, q: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """V Q for the covariance V of the fit list: one pass over its centred rows."""

    def partial(column: pa.Array) -> np.ndarray:
        x = _centred(unpack(column, len(q)), n, sums)[0].astype(np.float64) / n
        return x.T @ (x @ q)

    return _summed(partial, fit, q.shape) / n


def _iterate(fit: DataFrame, dim: int, k: int, n: int, sums: list[int], seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Values and vectors of the k largest components, and the passes they took."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((dim, min(dim, k + EXTRA))))[0]
    before, passes = math.inf, 0
    while True:
        z = _times_covariance(fit, q, n, sums)
        passes += 1
        small = q.T @ z
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = q @ turn, z @ turn
        residual = np.linalg.norm(image[:, :k] - ritz[:, :k] * values[:k], axis=0).max(initial=0)
        scale = max(float(values[0]), 0.0)
        if residual <= TIGHT * scale or (residual <= LOOSE * scale and residual > before / 2) or passes >= MOST_PASSES:
            break
        gain = before / residual if math.isfinite(before) else math.inf
        due = math.log(residual / (TIGHT * scale)) / math.log(gain) if gain > 1 else math.inf
        wider = q.shape[1] < dim and math.isfinite(before) and due > PATIENCE
        before = math.inf if wider else residual
        if wider:
            image = np.hstack([image / scale, rng.standard_normal((dim, min(dim, 2 * q.shape[1]) - q.shape[1]))])
        q = np.linalg.qr(image)[0]
    if residual > LOOSE * scale:
        raise RuntimeError(f"{passes} passes left a residual of {residual:.3g} against a largest eigenvalue of {scale:.3g}")
    real = values[:k] > 8 * dim * np.finfo(float).eps * scale
    return values[:k][real], ritz[:, :k][:, real], passes


def fit(vectors: DataFrame, vector: str = "embedding", k: int = 4, seed: int = 11) -> Model | None:
    """The whitening of the distinct vectors of a column; None where there are none."""
    rows = checkpoint(integer_rows(vectors, vector, []).distinct())
    dim = usual_dim(rows)
    if not dim:
        return None
    listed = rows.where(F.col("dim") == dim).select("x")
    n = listed.count()
    totals = listed.mapInArrow(tidy(_sums(dim)), "place int, total string").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    *sums, squares = (int(r["total"]) for r in totals.orderBy("place").collect())
    spread = n * squares - sum(s * s for s in sums)  # n^2 times the trace
    if not spread:
        return Model(n, tuple(sums), np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0, 0)
    values, components, passes = _iterate(listed, dim, min(k, dim), n, sums, seed)
    size = len(values)

    def partial(column: pa.Array) -> np.ndarray:
        white = _whiten(_centred(unpack(column, dim), n, sums)[0], n, values, components)
        return np.vstack([white.sum(0), white.T @ white])

    got = _summed(partial, listed, (size + 1, size)) / n
    error = np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(size)).max(initial=0)
    return Model(n, tuple(sums), values, components, spread / n**2, float(error), passes)


def _whiten(centred: np.ndarray, n: int, values: np.ndarray, components: np.ndarray) -> np.ndarray:
    return (centred.astype(np.float64) / n) @ components / np.sqrt(values)


def whiten(vectors: DataFrame, model: Model | None, names: list[str], vector: str = "embedding") -> DataFrame:
    """The named columns of every row that takes part, with deviation (the exact sum of (n x - S)^2, null beyond a long) and whitened, an array."""
    dim = len(model.sums) if model else 0
    rows = integer_rows(vectors, vector, names).where(F.col("dim") == dim)
    kinds = with_fields(rows.drop("dim", "x").schema, "deviation bigint, whitened array<double>")
    if not model:
        return vectors.sparkSession.createDataFrame([], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred, small = _centred(unpack(batch.column(len(names) + 1), dim), model.n, list(model.sums))
            if small and int(np.abs(centred).max(initial=0)) ** 2 * dim >= 1 << 63:
                centred, small = centred.astype(object), False
            deviation = [int(d) if int(d) < 1 << 63 else None for d in (centred * centred).sum(1)]
            white = _whiten(centred, model.n, model.values, model.vectors)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(deviation, pa.int64()), lists], names=[*names, "deviation", "whitened"])

    return rows.mapInArrow(tidy(run), kinds)


def components(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 4) -> DataFrame:
    """A row for each vector and component: the id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, vector, k)
    rows = whiten(vectors, model, [id_column], vector).select(id_column, "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = [float(v / model.trace) for v in model.values] if model else []
    share = F.get(F.array(*map(F.lit, shares)), F.col("place")) if shares else F.lit(None).cast("double")
    n, error = (model.n, model.identity_error) if model else (0, 0.0)
    return rows.select(id_column, (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
