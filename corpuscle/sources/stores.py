"""Versioned stores: parts are written under names of their own, and count once a one-row log entry names them.

The entry is appended last, by a write of a single row, so that what a lost driver or executor leaves behind is never read. Readers take the entries
there are when they begin.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "entry string, kind string, at bigint, folder string, covers array<string>, figures map<string,double>"


class Store:
    """A folder of parts with a log. ``entry`` is the caller's id of a write, so that a repeated one can be told."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> list[Row]:
        """Entries by time; one a write, so few."""
        try:
            rows = self.spark.read.schema(LOG).parquet(f"{self.path}/log").collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted(rows, key=lambda r: (r["at"], r["entry"]))

    def live(self) -> list[Row]:
        """The entries that make up the store: the last that stands for others, and those it does not stand for."""
        entries = {r["entry"]: r for r in reversed(self.log())}  # the first of a repeated entry counts
        covered = {c for r in entries.values() for c in r["covers"]}
        return sorted((r for r in entries.values() if r["entry"] not in covered), key=lambda r: (r["at"], r["entry"]))

    def known(self, entry: str) -> bool:
        return any(entry == r["entry"] or entry in r["covers"] for r in self.log())

    def folder(self) -> str:
        """A new folder for the parts of one write."""
        return f"parts/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, folder: str, part: str, by: str | None = None) -> DataFrame:
        """Write one part, in folders by a column if one is named, and read it back."""
        path = f"{self.path}/{folder}/{part}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(self, entry: str, kind: str, folder: str, covers: list[str] | None = None, figures: dict[str, float] | None = None) -> None:
        told = {k: float(v) for k, v in (figures or {}).items()}
        columns = {
            "entry": F.lit(entry), "kind": F.lit(kind), "at": F.lit(time.time_ns()).cast("bigint"), "folder": F.lit(folder), "covers": F.array(*map(F.lit, covers or [])).cast("array<string>"),
            "figures": F.map_from_arrays(F.array(*map(F.lit, told)).cast("array<string>"), F.array(*map(F.lit, told.values())).cast("array<double>")),
        }
        self.spark.range(0, 1, 1, 1).select(*[c.alias(n) for n, c in columns.items()]).write.mode("append").parquet(f"{self.path}/log")

    def part(self, part: str, schema: str) -> DataFrame:
        """One part of all live entries together."""
        paths = [f"{self.path}/{r['folder']}/{part}" for r in self.live()]
        if not paths:
            # made by the JVM: createDataFrame would start a Python worker a core for no row
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
        out = None
        for path in paths:
            one = self.spark.read.schema(schema).parquet(path)
            out = one if out is None else out.unionByName(one)
        return out

    def purge(self) -> int:
        """Delete the parts that no live entry names: what compaction replaced and what failed writes left. Not while others write."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        root = hadoop(f"{self.path}/parts")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0
        used = {r["folder"].rsplit("/", 1)[-1] for r in self.live()}
        gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in used]
        return sum(bool(fs.delete(path, True)) for path in gone)
