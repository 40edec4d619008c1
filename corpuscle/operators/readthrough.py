"""Read-through by content hash: what a model makes of a text is made once, stored, and joined back to all rows with that text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import Store

_HELD = "hash string, vector array<double>"


def text_hash(text: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


class ReadThrough:
    """``embed(df, text column, vector column)`` adds vectors; it only ever sees each text once, whichever rows have it."""

    def __init__(self, store: Store, embed: Callable[[DataFrame, str, str], DataFrame]):
        self.store, self.embed = store, embed

    def held(self) -> DataFrame:
        return self.store.part("vectors", _HELD)

    def __call__(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        """``rows`` with the vector of each row's text and ``<out>_cached``, whether it was there before."""
        known = self.held()
        asked = rows.select(text_hash(text).alias("_hash"), F.coalesce(F.col(text), F.lit("")).alias("_text")).dropDuplicates(["_hash"])
        folder = self.store.folder()
        misses = asked.join(known.select(F.col("hash").alias("_hash")), "_hash", "left_anti")
        made = self.store.write(self.embed(misses, "_text", "vector").select(F.col("_hash").alias("hash"), F.col("vector").cast("array<double>").alias("vector")), folder, "vectors")
        n = made.count()
        if n:
            self.store.commit(folder, "add", folder, figures={"vectors": n})
        both = known.withColumn("_known", F.lit(True)).unionByName(made.withColumn("_known", F.lit(False)))
        both = both.select(F.col("hash").alias("_hash"), F.col("vector").alias(out), F.col("_known").alias(f"{out}_cached"))
        return rows.withColumn("_hash", text_hash(text)).join(both, "_hash").drop("_hash")

    def compact(self) -> None:
        """One part in place of all; of equal hashes, which two writers may have made at once, one stays."""
        entries = self.store.live()
        if len(entries) > 1:
            folder = self.store.folder()
            self.store.write(self.held().dropDuplicates(["hash"]), folder, "vectors")
            self.store.commit(folder, "compact", folder, sorted({c for r in entries for c in (r["entry"], *r["covers"])}), {"vectors": sum(r["figures"]["vectors"] for r in entries)})
