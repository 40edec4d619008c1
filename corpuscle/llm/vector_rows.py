"""Vectors as rows of integers, packed into a few bytes an entry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import tidy

#: An entry becomes the floor of so many times itself.
SCALE = 256
WIDTHS = (2, 4, 8)


def pack(x: np.ndarray) -> bytes:
    """The integers in the narrowest width that holds all of them; equal vectors have equal bytes."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    width = next(w for w in WIDTHS if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the n + 1 borders of the values among them."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """The int64 matrix of a column of packed vectors of one length."""
    out = np.empty((len(column), dim), np.int64)
    raw, borders = bytes_of(column)
    size = int(borders[1]) if len(column) else 0
    if size and np.array_equal(borders, size * np.arange(len(borders))):  # all of one width
        return np.ascontiguousarray(raw.reshape(-1, size)[:, 1:]).view(f"<i{(size - 1) // dim}").astype(np.int64)
    for i, value in enumerate(column):
        raw = value.as_buffer()
        width = (raw.size - 1) // dim
        out[i] = np.frombuffer(raw, f"<i{width}", dim, 1)
    return out


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries as doubles, null as NaN, and the n + 1 borders of the vectors among them."""
    column = column.cast(pa.list_(pa.float64()))
    flat = column.flatten()  # leaves out what lies under null vectors
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64), np.append(0, np.cumsum(sizes)).astype(np.int64)


def _integers(width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(width)
            values, borders = _entries(column)
            scaled = np.floor(SCALE * values)
            good = np.isfinite(values) & (np.abs(scaled) < 2.0**63)
            bad = np.append(0, np.cumsum(~good))
            sizes = np.diff(borders)
            fit = (sizes > 0) & (bad[borders[1:]] == bad[borders[:-1]])
            at = np.flatnonzero(fit)
            whole = np.where(good, scaled, 0).astype(np.int64)
            packed = pa.array([pack(whole[borders[i] : borders[i + 1]]) for i in at], pa.binary())
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*kept.columns[:width], pa.array(sizes[at], pa.int32()), packed], names=[*names, "dim", "x"])

    return run


def integer_rows(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """The named columns, dim and x, of rows whose vector takes part: dim is its length, x its entries times SCALE, floored, packed.

    Rows with a null or empty vector, or with a null, non-finite or, once scaled, out-of-range entry (2^63) take no part.
    """
    some = df.select(*names, F.col(vector).cast("array<double>").alias("x"))
    return some.mapInArrow(tidy(_integers(len(names), names)), with_fields(some.drop("x").schema, "dim int, x binary"))


def with_fields(schema: StructType, more: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def usual_dim(rows: DataFrame) -> int:
    """The most frequent length of the vectors, of equally frequent ones the largest; 0 without rows."""
    first = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    return first["dim"] if first else 0
