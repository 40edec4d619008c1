"""A stored inverted index of metadata: (field, value) to row ids, in a folder for each field, and searches narrowed by it."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..sources.stores import Store
from .vectors import dense_topk

_ENTRIES = "value string, id bigint, field string"


def _value(df: DataFrame, name: str) -> Column:
    """A field's value as text; lists and records as JSON, so that equal ones are equal."""
    nested = isinstance(df.schema[name].dataType, (ArrayType, MapType, StructType))
    return F.to_json(F.col(name)) if nested else F.col(name).cast("string")


class MetadataIndex:
    """Entries of a field lie together, sorted by value, so a lookup reads one folder and skips row groups by their bounds."""

    def __init__(self, spark: SparkSession, path: str):
        self.store, self.spark = Store(spark, path), spark

    def build(self, rows: DataFrame, key: str, fields: list[str], batch: str = "first") -> None:
        """Index the fields of a batch of rows; null has no entry. A batch that is known changes nothing."""
        if self.store.known(batch):
            return
        folder = self.store.folder()
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), _value(rows, f).alias("value")) for f in fields])
        entries = rows.select(F.col(key).cast("bigint").alias("id"), F.explode(pairs).alias("e")).select("e.value", "id", "e.field").where("value is not null")
        # by value as well: a field with most entries of one value is still many tasks' work, since the id goes along
        held = self.store.write(entries.repartitionByRange("field", "value", "id").sortWithinPartitions("field", "value", "id"), folder, "entries", "field")
        self.store.commit(batch, "add", folder, figures={"entries": held.count()})

    def entries(self) -> DataFrame:
        return self.store.part("entries", _ENTRIES)

    def search(self, wanted: dict[str, str]) -> DataFrame:
        """id of the rows that have all the values; an unknown field or value has none."""
        if not wanted:
            raise ValueError("no field is named")
        some = self.entries().where(F.col("field").isin(list(wanted)))
        fits = functools.reduce(operator.or_, [(F.col("field") == f) & (F.col("value") == str(v)) for f, v in wanted.items()])
        found = some.where(fits).select("id", "field").distinct()
        return found.groupBy("id").count().where(F.col("count") == len(wanted)).select("id")

    def stats(self) -> DataFrame:
        """field, distinct values, entries."""
        counts = self.entries().groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("field").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_entries"))

    def search_vectors(self, corpus: DataFrame, key: str, vector: str, queries: DataFrame, wanted: dict[str, str], k: int) -> DataFrame:
        """The best rows of each query among those that have all the values; vectors of others are not scored."""
        held = corpus.join(self.search(wanted).withColumnRenamed("id", key), key, "left_semi")
        return dense_topk(held, queries, key, vector, k)
