"""Statistics of series, percentile rules, anomalies, alerts and health, as DataFrame operators.

Ranks within a series are counted by ranges of its values, and frames of neighbours are computed within blocks of the series
(``series``); groups are plain aggregates, which Spark pre-aggregates on the map side.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which a series is split to rank it.
RANGES = 64


def _same(keys: list[str], left: str, right: str) -> Column:
    return functools.reduce(operator.and_, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def numbered(df: DataFrame, keys: list[str], order: list[str], ranges: int = RANGES) -> DataFrame:
    """Adds _at, a row's 0-based place among its key's rows in order, and n, their number.

    A key's rows are split into ranges of the first order column at approximate quantiles, numbered within each, and moved by
    the counts of the ranges before, of which a key has ``ranges`` at most: a key with most of all rows is many tasks' work.
    """
    first = F.col(order[0])  # a number, a date or a time
    cuts = df.groupBy(*keys).agg(F.percentile_approx(first, [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    placed = df.alias("l").join(cuts.alias("r"), _same(keys, "l", "r")).select("l.*", F.size(F.filter("_cuts", lambda c: c <= first)).alias("_range"))
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_start": F.coalesce(F.sum("_c").over(upto), F.lit(0)), "n": F.sum("_c").over(Window.partitionBy(*keys))})
    within = placed.withColumn("_within", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1)
    joined = within.alias("l").join(counts.alias("r"), _same([*keys, "_range"], "l", "r"))
    return joined.select("l.*", (F.col("_start") + F.col("_within")).alias("_at"), "r.n").drop("_range", "_within")


def rank_pick(df: DataFrame, keys: list[str], value: str, places: dict[str, Column], ties: list[str]) -> DataFrame:
    """For each key, the values at 0-based places of the sorted series; a place is a column over ``n``, the series' length."""
    rows = numbered(df.select(*keys, value, *[c for c in ties if c not in (*keys, value)]), keys, [value, *ties])
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("_at") == place, F.col(value))).alias(name) for name, place in places.items()])


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The exact median of each key's values, null ones left out."""
    n = F.col("n")
    picks = rank_pick(df.where(F.col(value).isNotNull()), keys, value, {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2)}, [])
    return picks.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def percentile_place(p: float, rule: str) -> Column:
    """0-based place of percentile p (0 to 1) under a rule: ``n1`` int((n-1)p), ``clamped`` min(int(np), n-1), ``raw`` int(np), ``quarter`` int(np) by whole division."""
    n = F.col("n")
    if rule == "n1":
        return F.floor((n - 1) * F.lit(p))
    if rule == "clamped":
        return F.least(F.floor(n * F.lit(p)), n - 1)
    if rule in ("raw", "quarter"):
        return F.floor(n * F.lit(p))
    raise ValueError(rule)


def trend(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Least-squares slope over the index, and its name beyond 0.05."""
    slopes = numbered(df, keys, order).groupBy(*keys).agg(F.regr_slope(value, "_at").alias("slope"))
    slope = F.coalesce("slope", F.lit(0.0))
    return slopes.select(*keys, F.round(slope, 6).alias("slope"), F.when(slope > 0.05, "increasing").when(slope < -0.05, "decreasing").otherwise("stable").alias("trend"))


def volatility(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Sample deviation of step returns; a step from 0 counts as 0."""
    from .series import with_frames

    steps = with_frames(df.select(*keys, *order, value), keys, order, {"_b": F.lag(value).over}, behind=1).where("_b is not null")
    steps = steps.withColumn("_r", F.when(F.col("_b") == 0, 0.0).otherwise((F.col(value) - F.col("_b")) / F.col("_b")))
    return steps.groupBy(*keys).agg(F.round(F.coalesce(F.stddev_samp("_r"), F.lit(0.0)), 6).alias("volatility"))


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key; ``order`` sorts newest first."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def zscore_anomalies(df: DataFrame, keys: list[str], value: str, order: list[str], history: int, threshold: float = 2.0) -> DataFrame:
    """Rows whose value lies more than ``threshold`` sample deviations from the mean of the rows before it."""
    from .series import with_frames

    over = lambda figure: lambda along: figure(value).over(along.rowsBetween(-history, -1))
    rows = with_frames(df, keys, order, {"_m": over(F.avg), "_s": over(F.stddev_samp)}, behind=history)
    z = (F.col(value) - F.col("_m")) / F.col("_s")
    rows = rows.where("_s > 0").withColumn("z", z).where(F.abs("z") > threshold)
    return rows.withColumns({"kind": F.when(F.col("z") > 0, "spike").otherwise("dip"), "confidence": F.least(F.lit(1.0), F.abs("z") / (2 * threshold))}).drop("_m", "_s")


def iqr_anomalies(df: DataFrame, keys: list[str], value: str, order: list[str], history: int, factor: float = 1.5) -> DataFrame:
    """Rows outside the index quartiles of the rows before, by ``factor`` times their distance; four rows at least.

    A row's list holds ``history`` values at most.
    """
    from .series import with_frames

    rows = with_frames(df, keys, order, {"_h": lambda along: F.collect_list(value).over(along.rowsBetween(-history, -1))}, behind=history)
    rows = rows.where(F.size("_h") >= 4).withColumn("_h", F.sort_array("_h"))
    n = F.size("_h")
    q1, q3 = F.get("_h", F.floor(n / 4).cast("int")), F.get("_h", F.floor(3 * n / 4).cast("int"))
    rows = rows.withColumns({"q1": q1, "q3": q3}).drop("_h")
    reach = factor * (F.col("q3") - F.col("q1"))
    return rows.where((F.col(value) < F.col("q1") - reach) | (F.col(value) > F.col("q3") + reach)).withColumn("kind", F.when(F.col(value) > F.col("q3"), "spike").otherwise("dip"))


def mad_anomalies(df: DataFrame, keys: list[str], value: str, threshold: float = 2.0) -> DataFrame:
    """Rows whose 0.6745 * (value - median) / MAD exceeds the threshold; none where the MAD is 0."""
    middle = medians(df, keys, value).withColumnRenamed("median", "_median")
    off = df.join(middle, keys).withColumn("_off", F.abs(F.col(value) - F.col("_median")))
    mad = medians(off, keys, "_off").withColumnRenamed("median", "_mad")
    scored = off.join(mad, keys).where("_mad > 0").withColumn("score", F.lit(0.6745) * (F.col(value) - F.col("_median")) / F.col("_mad"))
    return scored.where(F.abs("score") > threshold).drop("_off", "_median", "_mad")


def condition(value: Column, op: Column, threshold: Column, tolerance: float = 1e-4) -> Column:
    """An alert rule's comparison by the rule's own operator; (in)equality with a tolerance."""
    near = F.abs(value - threshold) < tolerance
    return (
        F.when(op == ">", value > threshold).when(op == "<", value < threshold).when(op == ">=", value >= threshold)
        .when(op == "<=", value <= threshold).when(op == "==", near).when(op == "!=", ~near).otherwise(F.lit(False))
    )


def half_trend(df: DataFrame, keys: list[str], value: str, order: list[str], faithful: bool = False) -> DataFrame:
    """Means of the first and second half. ``faithful`` sorts by value instead of time, so the second is never smaller."""
    rows = numbered(df, keys, [value, *order] if faithful else order)
    first = F.avg(F.when(F.col("_at") < F.floor(F.col("n") / 2), F.col(value)))
    second = F.avg(F.when(F.col("_at") >= F.floor(F.col("n") / 2), F.col(value)))
    means = rows.groupBy(*keys).agg(first.alias("first_half"), second.alias("second_half"))
    return means.select(*keys, F.round("first_half", 6).alias("first_half"), F.round("second_half", 6).alias("second_half"), F.when(F.col("second_half") > F.col("first_half"), "degrading").otherwise("improving").alias("trend"))


def within(df: DataFrame, time: str, now: Column, minutes: float) -> DataFrame:
    """The rows of the last so many minutes."""
    return df.where(F.col(time) >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(minutes))))


def rollback_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rollbacks, completed, failed, success_rate, mean_loss (of those completed) and bytes of rows of status, loss, bytes."""
    done = F.col("status") == "completed"
    told = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rollbacks"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.avg(F.when(done, F.col("loss"))).alias("_loss"), F.sum("bytes").alias("bytes"))
    return told.select(*keys, "rollbacks", "completed", "failed", F.round(F.col("completed") / F.col("rollbacks"), 6).alias("success_rate"), F.round(F.coalesce("_loss", F.lit(0.0)), 6).alias("mean_loss"), "bytes")


def status_of(failures: Column, total: Column) -> Column:
    return F.when(failures == total, "unhealthy").when(failures > 0, "degraded").otherwise("healthy")
