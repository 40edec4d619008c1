"""Files and settings around the engine: logs written by a stream, reports as JSON, uploads, settings, and registries of state."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_log(rows: DataFrame, path: str) -> None:
    """Entries (kind, payload): a ``list`` is a CSV line as it stands, a ``dict`` a JSON line; other kinds are left out."""
    for kind, folder in (("list", "csv"), ("dict", "jsonl")):
        rows.where(F.col("kind") == kind).select("payload").write.mode("append").text(f"{path}/{folder}")


def stream_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the entries of a stream as they come; a batch that is repeated after a failure replaces what it wrote."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        for kind, folder in (("list", "csv"), ("dict", "jsonl")):
            rows.where(F.col("kind") == kind).select("payload").write.mode("overwrite").text(f"{path}/{folder}/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def read_log(spark: SparkSession, path: str, folder: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(f"{path}/{folder}").withColumnRenamed("value", "payload")


def export_metrics(report: DataFrame, path: str) -> None:
    """A report as JSON lines, in place of an earlier one."""
    report.write.mode("overwrite").json(path)


def land(files: DataFrame, folder: str, buckets: int = 64) -> int:
    """Write rows (name, content) as files of these names in a bounded number of subfolders, and count them.

    Each task puts its own files where they belong, in a store that Arrow reaches: a table's writer makes a folder and a commit of each
    file, and on a local disk starts a process for each permission. A file appears whole, by a rename, so a repeated task changes nothing.
    """
    at = folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(at)
        made = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = f"{root}/{zlib.crc32(name.encode()) % buckets:04d}"
                if place not in made:
                    store.create_dir(place, recursive=True)
                    made.add(place)
                part = f"{place}/.{uuid.uuid4().hex}"  # hidden from readers
                with store.open_output_stream(part) as out:
                    out.write(content or b"")
                store.move(part, f"{place}/{name}")
            yield pa.record_batch({"n": pa.array([len(batch)], pa.int64())})

    return files.select("name", F.col("content").cast("binary")).mapInArrow(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def uploads(spark: SparkSession, folder: str, suffix: str = ".pdf", stream: bool = False) -> DataFrame:
    """path, hash, length, content of the files that lie, or as a stream arrive, in a folder; other suffixes are turned away."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile")
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length bigint, content binary")
    files = reader.load(folder).where(F.endswith(F.lower("path"), F.lit(suffix)))
    return files.select("path", F.sha2("content", 256).alias("hash"), "length", "content")


def settings(path: str | None, defaults: Mapping[str, object], environment: Mapping[str, str] | None = None, prefix: str = "CORPUSCLE_") -> dict[str, object]:
    """Defaults, replaced by a JSON or YAML file's values, replaced by variables PREFIX_NAME cast to the default's type.

    A variable that cannot be cast leaves the value as it is. Names that the defaults do not have are kept from the file only.
    """
    told = dict(defaults)
    if path:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yml", ".yaml")):
            import yaml  # optional

            told |= yaml.safe_load(text) or {}
        else:
            told |= json.loads(text)
    for name, default in defaults.items():
        said = (os.environ if environment is None else environment).get(f"{prefix}{name}".upper())
        if said is not None:
            told[name] = _cast(said, default, told[name])
    return told


def _cast(said: str, default: object, otherwise: object) -> object:
    kinds: dict[type, Callable[[str], object]] = {bool: lambda s: s.strip().lower() in ("1", "true", "yes", "on"), int: int, float: float}
    try:
        return kinds.get(type(default), str)(said)
    except ValueError:
        return otherwise


def write_report(rows: DataFrame, key: str, scores: list[str], path: str) -> None:
    """An evaluation's report: a summary row of the scores' means, and the rows themselves."""
    detail = rows.select(F.lit("detail").alias("part"), F.col(key).cast("string").alias("name"), *[F.col(s).cast("double").alias(s) for s in scores])
    summary = rows.agg(*[F.round(F.avg(s), 6).alias(s) for s in scores]).select(F.lit("summary").alias("part"), F.lit("mean").alias("name"), *scores)
    detail.unionByName(summary).write.mode("errorifexists").partitionBy("part").json(path)


def read_report(spark: SparkSession, path: str, scores: list[str]) -> DataFrame:
    return spark.read.schema(f"name string, {', '.join(f'`{s}` double' for s in scores)}, part string").json(path)


def save_registry(rows: DataFrame, path: str, version: int) -> None:
    """A registry of state (deployments, migrations, checkpoints) as a new version; older ones stay."""
    rows.write.mode("errorifexists").json(f"{path}/version={version}")


def load_registry(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of one version, or of the newest."""
    rows = spark.read.schema(f"{schema}, version int").json(path)
    newest = rows.agg(F.max("version").alias("_v"))
    return (rows.where(F.col("version") == version) if version is not None else rows.join(F.broadcast(newest), rows["version"] == newest["_v"]).drop("_v")).drop("version")
