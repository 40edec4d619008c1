"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source is due ``target / size`` copies of its words. The whole part is certain and goes to all of its documents. For
the fraction f, each document has an inclusion probability p of its own: its odds are f / (1 - f) times the root of the
source's mean size over the document's, so long documents are likelier to be left to their whole copies, and the sample's
words vary less. Documents are ranked by their random odds over their inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken
in that order while their words fit what is still due: the sample's fixed size is one in words, the unit of the targets.
Documents too long for the rest are passed over, and the walk along the same ranks is repeated a few times over those that
still fit, so that the sum ends near the target even where a document is larger than the rest.

Scale: text is read once for its word count and never shuffled; what is ranked is a narrow row a document. Sums along
the order run over buckets of the order (see running_sum), so a source with a third of the rows is no single task. Only
the table of sources, one row each, is handled in one task.

Null source: a source of its own, last. Null text: size 0, nothing taken. Rows equal in doc_id
and size have one rank, and are taken together or not at all. Tables without rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, running_sum, unit_hash

BUCKETS = 1024
#: Walks along the order: the first takes the sample, the others fill what documents passed over have left.
WALKS = 4


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with target: ``share`` of all sizes by weight, at most ``most`` times a source's size, the excess reshared.

    The weights repeat along the sources by code point, null last. Sharing the excess until nothing is above is the same
    as one level x with target = min(most * size, x * weight), found at the source where the caps reached leave x below.
    """
    row = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    cases = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((row - 1) % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("_w", cases).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy(F.lit(0))
    upto = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0))
    level = weighed.withColumn("_x", left / weight)
    # along the order x rises while caps lie under it and falls afterwards: its largest fitting value is the level
    fits = F.max(F.when(F.col("_x") * F.col("_w") <= F.col("_cap"), F.col("_x"))).over(everything)
    return level.select(*sources.columns, F.when(fits.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), fits * F.col("_w"))).alias("target"))


def pareto_key(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; the smallest come first."""
    inside = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return (u / (1 - u)) / (inside / (1 - inside))


def inclusion(size: Column, f: Column, mean: Column) -> Column:
    """A document's inclusion probability, where the source's documents of mean size have f."""
    inside = F.least(F.greatest(f, F.lit(1e-12)), F.lit(1 - 1e-12))
    odds = (inside / (1 - inside)) * F.sqrt(F.greatest(mean, F.lit(1.0)) / F.greatest(size, F.lit(1)))
    return odds / (1 + odds)


def _sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _walked(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, buckets: int, walks: int) -> tuple[DataFrame, DataFrame]:
    """The rows with _taken, and for each source its target, whole copies, and each walk's last rank key and longest size."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("_n"))
    targets = source_targets(sizes, weights, share, most)
    targets = targets.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)))
    first = F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size"))
    told = targets.withColumns({"_due": first, "_f": F.when(F.col("source_size") > 0, first / F.col("source_size")), "_mean": F.col("source_size") / F.greatest("_n", F.lit(1))})
    told = checkpoint(told.withColumn("_walks", F.array().cast("array<struct<last:double,due:double>>")))
    own = told.select(F.col("source").alias("_s"), "_f", "_mean")
    state = rows.join(own, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_q", _key())
    # a bucket follows the key, of which the median lies near 1 / (the source's odds)
    f = F.least(F.greatest("_f", F.lit(1e-12)), F.lit(1 - 1e-12))
    even = F.coalesce(F.col("_q"), F.lit(0.0)) * (f / (1 - f))
    state = checkpoint(state.select("doc_id", "source", "size", "_q", F.coalesce(F.floor((1 - 1 / (1 + even)) * buckets), F.lit(0)).alias("_bucket"), F.lit(False).alias("_taken")))
    for _ in range(walks):
        due = told.select(F.col("source").alias("_s"), "_due")
        open_ = state.join(due, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        fits = ~F.col("_taken") & (F.col("size") > 0) & (F.col("size") <= F.col("_due"))
        along = open_.withColumn("_fits", F.coalesce(fits, F.lit(False)))
        summed = running_sum(along, ["source"], F.col("_bucket"), [F.col("_q")], F.when(F.col("_fits"), F.col("size")).otherwise(F.lit(0)), "_sum", peers=True)
        new = F.col("_fits") & (F.col("_sum") <= F.col("_due"))
        state = checkpoint(summed.select("doc_id", "source", "size", "_q", "_bucket", (F.col("_taken") | new).alias("_taken"), new.alias("_new")))
        spent = state.where("_new").groupBy(F.col("source").alias("_s")).agg(F.sum("size").alias("_spent"), F.max("_q").alias("_last"))
        state = state.drop("_new")
        walk = F.array(F.struct(F.coalesce("_last", F.lit(-1.0)).alias("last"), F.col("_due").alias("due")))
        told = told.join(spent, F.col("source").eqNullSafe(F.col("_s")), "left")
        told = checkpoint(told.withColumn("_walks", F.concat("_walks", walk)).withColumn("_due", F.col("_due") - F.coalesce("_spent", F.lit(0))).drop("_s", "_spent", "_last"))
    return state, told


def _key() -> Column:
    """The rank key of a row with its size and _u, and its source's _f and _mean."""
    return pareto_key(F.col("_u"), inclusion(F.col("size"), F.col("_f"), F.col("_mean")))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 29, buckets: int = BUCKETS, walks: int = WALKS
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies * size) of every row of doc_id, text, source."""
    rows = checkpoint(docs.select("doc_id", "source", _sizes(F.col("text")).alias("size"), unit_hash(F.lit(seed), F.col("doc_id")).alias("_u")))
    state, told = _walked(rows, weights, share, most, buckets, walks)
    copies = F.col("_whole") + F.col("_taken").cast("int")
    told = told.select(F.col("source").alias("_s"), "source_size", "target", "_whole")
    return state.join(told, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken")
    )


def repeat(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 29, buckets: int = BUCKETS, walks: int = WALKS) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``mix`` takes it.

    What a walk takes of a source is all that fits up to its last rank key, so each row's copies follow from its own size and u
    and a few numbers of its source, and no text is shuffled. The sources' numbers are broadcast up to 10,000 sources, and
    joined by a shuffle beyond it.
    """
    rows = checkpoint(docs.select("doc_id", "source", _sizes(F.col("text")).alias("size"), unit_hash(F.lit(seed), F.col("doc_id")).alias("_u")))
    _, told = _walked(rows, weights, share, most, buckets, walks)
    told = told.select(F.col("source").alias("_s"), "_whole", "_walks", "_f", "_mean")
    told = F.broadcast(told) if told.count() <= 10_000 else told
    names = docs.columns
    sized = docs.select(F.struct(*names).alias("_row"), F.col("source").alias("_o"), _sizes(F.col("text")).alias("size"), unit_hash(F.lit(seed), F.col("doc_id")).alias("_u"))
    joined = sized.join(told, F.col("_o").eqNullSafe(F.col("_s"))).withColumn("_q", _key())
    taken = F.exists("_walks", lambda w: (F.col("size") > 0) & (F.col("_q") <= w["last"]) & (F.col("size") <= w["due"]))
    copies = F.col("_whole").cast("int") + taken.cast("int")
    # a row without words takes part with its whole copies only
    many = joined.where(copies > 0).select("_row", F.explode(F.sequence(F.lit(1), copies)).alias("_copy"))
    return many.select(*[F.col("_row").getField(c).alias(c) for c in names])
