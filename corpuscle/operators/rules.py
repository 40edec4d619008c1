"""Rules over rows with their limits as parameters: lockouts, health, ranges of settings, sizes that need a split, clipped contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lockouts(attempts: DataFrame, user: str, at: str, ok: str, most: int = 5, seconds: float = 900.0) -> DataFrame:
    """Adds failures, those of the user in the last so many seconds up to the row, and locked, whether they are ``most``; a success forgets them.

    A user's attempts are one window's rows, cut at each success.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    before = Window.partitionBy(user).orderBy("_us", F.col(ok).cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    rows = attempts.withColumn("_us", micros).withColumn("_epoch", F.coalesce(F.sum(F.col(ok).cast("int")).over(before), F.lit(0)))
    recent = Window.partitionBy(user, "_epoch").orderBy("_us").rangeBetween(-(int(seconds * 1_000_000) - 1), 0)
    rows = rows.withColumn("failures", F.when(F.col(ok), F.lit(0)).otherwise(F.sum((~F.col(ok)).cast("int")).over(recent)).cast("bigint"))
    return rows.withColumn("locked", F.col("failures") >= most).drop("_us", "_epoch")


def healthy(nodes: DataFrame, limits: dict[str, float]) -> DataFrame:
    """The rows whose every named figure is below its limit; a missing figure is not."""
    fits = F.lit(True)
    for figure, limit in limits.items():
        fits = fits & F.coalesce(F.col(figure) < limit, F.lit(False))
    return nodes.where(fits)


def violations(settings: DataFrame, key: str, ranges: dict[str, tuple[float, float]], crossed: dict[str, Column]) -> DataFrame:
    """key, rule: each setting outside its range (both ends count as inside; null is outside), and each named condition that holds."""
    broken = [F.when(~F.coalesce(F.col(name).between(low, high), F.lit(False)), F.lit(f"{name} not in {low:g}..{high:g}")) for name, (low, high) in ranges.items()]
    broken += [F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in crossed.items()]
    return settings.select(key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def needs_split(chunks: DataFrame, keys: list[str], text: str, size: int, factor: float = 1.5) -> DataFrame:
    """keys, needs_split, longest: whether any chunk of a document is longer than ``factor`` times the size."""
    longest = F.coalesce(F.max(F.length(text)), F.lit(0))
    return chunks.groupBy(*keys).agg(longest.alias("longest")).withColumn("needs_split", F.col("longest") > factor * size)


def clipped(context: Column, marker: str = "\n\n", parts: int = 5, chars: int = 3000) -> Column:
    """The first parts between markers that are not blank; a context without the marker is cut at so many characters."""
    held = F.slice(F.filter(F.split(context, f"\\Q{marker}\\E"), lambda p: F.trim(p) != ""), 1, parts)
    return F.when(F.contains(context, F.lit(marker)), held).otherwise(F.array(F.substring(context, 1, chars)))
