"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, and components of the links.

Texts with equal shingle sets form a class, which is joined once. The shingles of a class are put in one order for all,
rare ones first, and the first ``n - ceil(t * n) + 1`` of them are its prefix: two classes of similarity t or more share
a shingle of their prefixes. Candidates from shared shingles pass the length filter (the smaller set has at least t times
the larger one's size), the positional filter (what the places of the shared shingle leave possible) and, in place of the
recursive suffix filter, a bound on the sets' symmetric difference: the bits in which their parities over 1024 hash ranges, or over as many as
the sets have shingles, differ. What remains is verified, once per pair, on whole sets.

All links are needed only as far as they join components, so a shared shingle is not expanded into all pairs: its holders
are ranked by how much they share with others, and are compared with the first one, next with the following four, then
with all that remain, each time only across components found so far, and only while a shingle has holders in two. In the
last round holders meet by bands of size, and a pair only where none of the few shingles before, in either one's order, is
common to both: such a pair has met there already. So a shingle all of whose holders share the one before it is left out
as a whole. No pair of classes in different components is lost, and the components are exactly those of the join.

The order: a shingle's rarity is its count over all documents in a sketch of 2^20 counters (4 MB whatever the input);
counters can only be too high. Any order gives the same result; a coarse one only makes prefixes less selective.

Scale: three passes over the texts in numpy (counts; prefixes; sets of candidates only). What is shuffled are prefixes
(about a tenth of the shingles at 0.9) and a narrow row with parities per document. Copies post their prefix once per task
and find their class once per task. Holders of a shingle that the sketch counts far above its median are spread over salts
from the start, so no task gets all holders of a frequent shingle. Components never leave Spark.

Null or empty texts and texts without a word have no shingles, and are a component of their own. Repeated doc_ids are
separate rows, each in the component of its text. Tables without rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, mix64, slices, texts_of, tidy
from .components import components
from .shingles import shingle_sets

SKETCH_BITS, BLOCK_BITS = 20, 12
#: 64-bit words of a set's parities.
PARITY_WORDS = 16
FIRST_PIVOTS = (1, 5)
#: Holders of a shingle in one salt, about, and how many shingles before a common one are looked at.
SALTED_FROM, BEFORE = 512, 6
#: Salts that meet in one task of the last round, where each holder is compared with all.
JOINED_SALTS = 16
#: As many candidate ids at most are broadcast to pick their texts; beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Members of a class that meet it in one task, about.
MEMBERS = 64
BATCH_BYTES = 1 << 19
_U = np.uint64


def _class_key(shingles: np.ndarray) -> bytes:
    """16 bytes that name a set of shingles."""
    place = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        parts = [int(mix64(np.array([np.add.reduce(mix64(shingles ^ _U(seed)) * (place * _U(2) + _U(1))) ^ _U(len(shingles))]))[0]) for seed in (0xA5A5, 0x5A5A5A)]
    return parts[0].to_bytes(8, "big") + parts[1].to_bytes(8, "big")


def _half(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def _sets(batch: pa.RecordBatch, column: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    raw, offsets = texts_of(batch.column(column))
    for i, j in slices(offsets, BATCH_BYTES):
        yield from enumerate(shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n), i)


def _parities(shingles: np.ndarray, bits: int = 64 * PARITY_WORDS) -> np.ndarray:
    """The parity of the number of shingles in each of ``bits`` hash ranges, a power of two, as signed 64-bit words."""
    odd = np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _fine_parities(shingles: np.ndarray) -> np.ndarray | None:
    """Parities over as many ranges as there are shingles at least; None where the usual number is as many."""
    bits = 1 << (len(shingles) - 1).bit_length()
    return _parities(shingles, bits) if bits > 64 * PARITY_WORDS else None


def _profile(n: int) -> Callable:
    """Row for each document (doc_id, class, size, parities, fine, task), and at the end of a task its shingle counts by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        task = TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]
        names = ["doc_id", "class", "size", "parities", "fine", "task", "block", "counts"]
        for batch in batches:
            keys, sizes, parities, fine = [], [], [], []
            for _, found in _sets(batch, 1, n):
                sizes.append(len(found))
                keys.append(_class_key(found) if len(found) else None)
                parities.append(_parities(found) if len(found) else None)
                fine.append(_fine_parities(found) if len(found) else None)
                at = (found >> _U(64 - SKETCH_BITS)).astype(np.int64)
                if len(found) > 20_000:
                    counts += np.bincount(at, minlength=len(counts)).astype(np.uint32)
                else:
                    np.add.at(counts, at, 1)
            none = [None] * len(keys)
            columns = (keys, sizes, parities, fine, [task] * len(keys), none, none)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(v, k) for v, k in zip(columns, kinds[1:], strict=True)]], names=names)
        width = 1 << BLOCK_BITS
        blocks = [(b, counts[b * width : (b + 1) * width]) for b in range(len(counts) // width)]
        blocks = [(b, c.tobytes()) for b, c in blocks if c.any()]
        none = [None] * len(blocks)
        columns = (none, none, none, none, none, none, [b for b, _ in blocks], [c for _, c in blocks])
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each block, one row at a time in memory."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(counts.as_buffer(), np.uint32)
            sums[block] = np.minimum(sums[block].astype(np.uint64) + part, 2**32 - 1).astype(np.uint32) if block in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["block", "counts"])


def _salts(counts: np.ndarray, usual: int, each: int) -> np.ndarray:
    """Over how many salts the holders of shingles of these counts are spread; one for all that are not far above the usual."""
    return np.maximum(1, -(-(counts.astype(np.int64) - 2 * usual) // each))


def _prefixes(n: int, percent: int, sketch: object, usual: int, each: int) -> Callable:
    """(token, spread, half, place) of each class's prefix, once for each class and task.

    spread: the token's number of salts, and below its 31 low bits the class's salt; half: the first 8 bytes of the class key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch.value, np.uint32)
        seen: set[bytes] = set()
        for batch in batches:
            tokens, spreads, halves, places = [], [], [], []
            for _, found in _sets(batch, 0, n):
                if not len(found):
                    continue
                key = _class_key(found)
                if key in seen:
                    continue
                seen.add(key)
                length = len(found) + (-percent * len(found)) // 100 + 1
                count = counts[(found >> _U(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((found, count))[:length]
                tokens.append(found[order].view(np.int64))
                salts = _salts(count[order], usual, each)
                spreads.append((salts << 31) + (int.from_bytes(key[8:], "big") >> 2) % salts)
                halves.append(np.full(length, _half(key), np.int64))
                places.append(np.arange(length, dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (tokens, spreads, halves, places)], names=["token", "spread", "half", "place"])

    return run


def _candidate_sets(n: int) -> Callable:
    """(center, salt, member, shingles) of the texts (text, id, class, center, salt) whose set is that of the class, once for each task.

    Of texts that share a doc_id, others may come along. Rows of one text that lie together have its set made once.
    """
    names = ["center", "salt", "member", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            ids, wanted, centers, salts = (batch.column(k).to_pylist() for k in range(1, 5))
            rows: list[list[int]] = []
            for i, role in enumerate(zip(centers, salts, ids, strict=True)):
                if role not in seen:
                    if rows and ids[rows[-1][0]] == ids[i] and batch.column(0)[rows[-1][0]] == batch.column(0)[i]:
                        rows[-1].append(i)
                    else:
                        rows.append([i])
            found: list[tuple[int, int, int, bytes]] = []
            once = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            for at, shingles in _sets(once, 0, n):
                if len(shingles) and _class_key(shingles) == wanted[rows[at][0]]:
                    raw = shingles.tobytes()
                    for i in rows[at]:
                        role = (centers[i], salts[i], ids[i])
                        if role not in seen:
                            seen.add(role)
                            found.append((*role, raw))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def _verify(percent: int) -> Callable:
    """Links (a, b) among rows of (center, salt, member, shingles) in which each center's own row comes before its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            for c, salt, member, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                shingles = np.frombuffer(raw.as_buffer(), np.uint64)
                if c == member:
                    center, own = (c, salt), shingles.copy()
                    continue
                if center != (c, salt):
                    raise RuntimeError(f"the set of class {c} is missing")
                both = len(np.intersect1d(own, shingles, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(shingles) - both):
                    links.append((min(c, member), max(c, member)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _needed(percent: int, s: Column, t: Column) -> Column:
    """The overlap that sets of sizes s and t need."""
    return F.ceil(percent * (s + t) / F.lit(100 + percent) - F.lit(1e-9))


def _possible(percent: int, s: Column, at: Column, t: Column, place: Column) -> Column:
    """Length and positional filter for sets of sizes s and t that hold one shingle at the given places."""
    length = 100 * F.least(s, t) >= percent * F.greatest(s, t)
    upto = F.least(at, place) + 1 + F.least(s - at, t - place) - 1
    return length & (upto >= _needed(percent, s, t))


def _parities_allow(percent: int, one: str, other: str) -> Column:
    """In place of the suffix filter: bits in which the sets' parities differ are a lower bound of their symmetric difference."""
    s, t = F.col(f"{one}.size"), F.col(f"{other}.size")
    differ = [F.bit_count(F.col(f"{one}.parities")[i].bitwiseXOR(F.col(f"{other}.parities")[i])) for i in range(PARITY_WORDS)]
    return functools.reduce(operator.add, differ) <= s + t - 2 * _needed(percent, s, t)


def _fine_parities_allow(percent: int, one: str, other: str) -> Column:
    """The same bound by the finer parities of sets that both have some, brought to the shorter ones' ranges; true for others."""
    s, t, a, b = (F.col(f"{side}.{c}") for c in ("size", "fine") for side in (one, other))
    words = F.least(F.size(a), F.size(b))
    xor = lambda p, q: p.bitwiseXOR(q)
    fold = lambda c: F.when(F.size(c) == 2 * words, F.zip_with(F.slice(c, 1, words), F.slice(c, words + 1, words), xor)).otherwise(c)
    differ = F.aggregate(F.zip_with(fold(a), fold(b), xor), F.lit(0), lambda total, word: total + F.bit_count(word))  # null at other lengths
    return F.coalesce(differ <= s + t - 2 * _needed(percent, s, t), F.lit(True))


def _band(percent: int) -> Column:
    """A number in which the sizes of two sets of enough similarity differ by one at most."""
    return F.floor(F.ln("size") / F.lit(math.log(100 / percent) + 1e-9)).cast("bigint")


def _meetings(live: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The rows of the last round: those whose pairs have not all met at the shingle before, with that and some before it."""
    own = Window.partitionBy("id").orderBy("place")
    rows = live.join(facts.select("id", "parities"), "id").withColumns({"last": F.lag("token").over(own), "before": F.collect_list("token").over(own.rowsBetween(-BEFORE, -1))})
    rows = checkpoint(rows.withColumn("band", _band(percent)))
    alike = rows.groupBy("token").agg(F.min("last").alias("_l"), F.max("last").alias("_h"), F.count("last").alias("_n"), F.count(F.lit(1)).alias("_all"), F.max("salts").alias("_s"))
    fresh = alike.where("_n < _all or _l <> _h").select("token", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("salt"))
    return rows.join(fresh, ["token", "salt"], "left_semi")


def ngram_jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for every row of doc_id, text.

    Texts link when ``100 * intersection >= percent * union`` of their sets of n-word shingles. class_id is the smallest
    doc_id with the same set, component_id the smallest that links reach.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = checkpoint(texts.mapInArrow(tidy(_profile(n)), "doc_id bigint, class binary, size bigint, parities array<bigint>, fine array<bigint>, task int, block int, counts binary"))
    rows = profile.where("block is null").select("doc_id", "class", "size", "parities", "fine", "task")
    blocks = profile.where("block is not null").select("block", "counts").repartition("block").mapInArrow(tidy(_add_up), "block int, counts binary")
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for block, part in blocks.collect():  # 2^20 counters together
        counts[block << BLOCK_BITS : (block + 1) << BLOCK_BITS] = np.frombuffer(part, np.uint32)
    sketch = spark.sparkContext.broadcast(counts.tobytes())
    half = F.conv(F.substring(F.hex("class"), 1, 16), 16, -10).cast("bigint")
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("parities").alias("parities"), F.first("fine").alias("fine"))

    posted = texts.select("text").mapInArrow(tidy(_prefixes(n, percent, sketch, int(np.median(counts)), SALTED_FROM)), "token bigint, spread bigint, half bigint, place bigint")
    posted = posted.repartition("token", "spread").dropDuplicates(["token", "spread", "half"])
    held = posted.withColumn("holders", F.count(F.lit(1)).over(Window.partitionBy("token", "spread")))
    salts, salt = F.shiftright("spread", 31).cast("int"), F.col("spread").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    held = held.select("token", salt.alias("salt"), salts.alias("salts"), "half", "place", "holders").where("holders > 1 or salts > 1")
    held = checkpoint(held)
    # from here on classes have short numbers; halves that two classes have in common stand for both
    weight = held.groupBy("half").agg(F.sum(F.col("holders") * F.col("salts")).alias("weight"))
    facts = checkpoint(classes.withColumn("half", half).join(weight, "half").withColumn("id", F.monotonically_increasing_id()))
    by_token = Window.partitionBy("token", "salt").orderBy(F.desc("weight"), "id")
    ranked = held.join(facts.select("half", "id", "size", "weight"), "half").select("token", "salt", "salts", "id", "size", "place", "holders", "weight")
    ranked = ranked.withColumns({"rank": (F.row_number().over(by_token) - 1) * F.col("salts") + F.col("salt"), "lead": F.first(F.struct("id", "size", "place")).over(by_token)}).drop("weight")
    ranked = checkpoint(ranked)
    del held, posted, weight

    groups = facts.select("id", F.col("id").alias("comp"))
    checked: DataFrame | None = None
    linked = False
    low = 0
    for high in (*FIRST_PIVOTS, None):
        if low == 0:  # all against the first holder, who stands in their rows; salted ones wait for the next round
            fits = _possible(percent, F.col("size"), F.col("place"), F.col("lead.size"), F.col("lead.place"))
            pairs = ranked.where("salts = 1 and rank > 0").where(fits).select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b"))
        else:
            # holders counts those of one salt: a shingle spread over salts may have more than any of them tells
            live = ranked.where((F.col("salts") > 1) | (F.col("holders") > low + 1)).drop("lead").join(groups, "id")
            mixed = live.groupBy("token").agg(F.min("comp").alias("_l"), F.max("comp").alias("_h"), F.max("salts").alias("_s")).where("_l <> _h")
            live = live.join(mixed.select("token", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("salt")), ["token", "salt"], "left_semi")
            on = [F.col(f"p.{c}") == F.col(f"m.{c}") for c in ("token", "group", "band")[: 2 + (high is None)]]
            meet = functools.reduce(operator.and_, on) & (F.col("p.rank") < F.col("m.rank")) & (F.col("p.comp") != F.col("m.comp"))
            meet &= _possible(percent, *(F.col(c) for c in ("p.size", "p.place", "m.size", "m.place")))
            if high is None:  # all against all: let no more through than must be
                meet &= ~F.arrays_overlap("p.before", "m.before") & _parities_allow(percent, "p", "m")
            live = checkpoint(live) if high else _meetings(live, facts, percent)
            pivots = live.where(F.col("rank") >= F.when(F.col("salts") > 1, F.lit(0 if low == FIRST_PIVOTS[0] else low)).otherwise(F.lit(low)))
            pivots = pivots.where(F.col("rank") < high) if high else pivots.withColumn("band", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
            together = F.col("salts") if high else F.ceil(F.col("salts") / JOINED_SALTS).cast("int")
            spread = pivots.withColumn("group", F.explode(F.sequence(F.lit(0), together - 1)))
            pairs = spread.alias("p").join(live.withColumn("group", F.pmod("salt", together)).alias("m"), meet).select(F.least("p.id", "m.id").alias("a"), F.greatest("p.id", "m.id").alias("b"))
        pairs = pairs.distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        x, y = (facts.select(F.col("id").alias(end), "size", "parities", "fine").alias(side) for end, side in (("a", "x"), ("b", "y")))
        pairs = pairs.join(x, "a").join(y, "b").where(_parities_allow(percent, "x", "y") & _fine_parities_allow(percent, "x", "y")).select("a", "b")
        pairs = checkpoint(pairs)
        low = high
        n_pairs = pairs.count()
        if not n_pairs:
            continue
        checked = pairs if checked is None else checked.unionAll(pairs)
        edges = checkpoint(_verified(texts, pairs, facts, n, percent, n_pairs))
        if edges.isEmpty():
            continue
        linked = True
        named, other = groups.toDF("a", "ca"), groups.toDF("b", "cb")
        roots = components(edges.join(named, "a").join(other, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        groups = checkpoint(groups.join(roots, F.col("comp") == F.col("node"), "left").select("id", F.coalesce("root", "comp").alias("comp")))

    own = classes.select("class", F.col("first").alias("class_id"))
    if linked:
        named = groups.join(facts.select("id", "class", "first"), "id")
        reached = named.join(named.groupBy("comp").agg(F.min("first").alias("least")), "comp").select("class", "least")
        own = own.join(reached, "class", "left").select("class", "class_id", F.coalesce("least", "class_id").alias("component_id"))
    else:
        own = own.withColumn("component_id", F.col("class_id"))
    # a class meets each task that read it once, and the task's rows by both, so that its copies are spread
    own = rows.where("class is not null").select("class", "task").distinct().join(own, "class")
    named = rows.select("doc_id", "class", "task", F.col("size").alias("n_shingles")).join(own, ["class", "task"], "left")
    return named.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _verified(texts: DataFrame, pairs: DataFrame, facts: DataFrame, n: int, percent: int, n_pairs: int) -> DataFrame:
    """The pairs of classes that link, by their whole shingle sets.

    Of a pair the class with more pairs is the center, and the other's set goes to it: sets are shuffled once, one for a
    pair and one for MEMBERS pairs of a center, whose pairs are spread over as many salts.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
    sided = pairs.join(degree.toDF("a", "_m"), "a").join(degree.toDF("b", "_n"), "b")
    first = F.col("_m") >= F.col("_n")
    sided = sided.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("center"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("member"), F.ceil(F.greatest("_m", "_n") / F.lit(MEMBERS)).alias("_salts"))
    sided = sided.withColumn("salt", F.pmod(F.xxhash64("member"), F.col("_salts")).cast("int"))
    roles = sided.select("center", "salt", "member").unionAll(sided.select("center", "salt", F.col("center").alias("member")).distinct())
    roles = roles.join(facts.select(F.col("id").alias("member"), "class", F.col("first").alias("_id")), "member")
    roles = checkpoint(roles)
    some = texts.join(F.broadcast(roles) if 2 * n_pairs <= BROADCAST_IDS else roles, F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = some.select("text", "member", "class", "center", "salt").mapInArrow(tidy(_candidate_sets(n)), "center bigint, salt int, member bigint, shingles binary")
    sets = sets.repartition("center", "salt").sortWithinPartitions("center", "salt", F.col("member") != F.col("center"))
    return sets.mapInArrow(tidy(_verify(percent)), "a bigint, b bigint")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``ngram_jaccard_groups``, the one of the smallest doc_id, with all columns of ``docs``.

    Of rows equal in doc_id and text one stays, of a component of rows that all lack a doc_id the first by text. Ids to drop
    are broadcast up to BROADCAST_IDS of them, and joined by a shuffle beyond it.
    """
    groups = checkpoint(ngram_jaccard_groups(docs, n, percent).select("doc_id", "component_id"))
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    # an id that names a component as well, of another row, is dropped by its row's text and not by its number
    both = gone.join(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"), F.col("_gone").eqNullSafe(F.col("doc_id")), "left_semi")
    repeated = groups.groupBy("doc_id").count().where("count > 1 and doc_id is not null")
    unnamed = groups.where("component_id is null").limit(2).count() > 1  # in one component or in two: ids do not tell
    if unnamed or not repeated.isEmpty() or not both.isEmpty():
        return _keep_one_of_repeated(docs, n, percent)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_id"))  # whole, as its columns may have any names
    return rows.join(gone, F.col("_id").eqNullSafe(F.col("_gone")), "left_anti").select("_row.*")


def _keep_one_of_repeated(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """keep_one for tables in which doc_ids repeat or several are null: rows are numbered first, in the order of doc_id and text."""
    names = docs.columns
    key = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    numbered = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").alias("_id"), F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit(""))), 256).alias("_same"), F.coalesce(F.col("text"), F.lit("")).alias("_text"), key.alias("_key"))
    ids = numbered.select("_same", "_id").distinct().orderBy(F.col("_id").isNull(), "_id", "_same").withColumn("_n", F.monotonically_increasing_id())
    ids = checkpoint(ids.select("_same", "_n"))
    rows = numbered.join(ids, "_same")
    once = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_n").orderBy("_key"))).where("_k = 1").select("_n", "_row", "_text")
    groups = ngram_jaccard_groups(once.select(F.col("_n").alias("doc_id"), F.col("_text").alias("text")), n, percent)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_n"))
    return once.join(kept, "_n", "left_semi").select(*[F.col("_row").getField(c).alias(c) for c in names])
