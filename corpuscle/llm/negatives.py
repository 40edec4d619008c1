"""Hard-negative mining by block matrix multiplication in the manner of SUMMA.

Scores are inner products of anchors with all rows: a matrix product, cut into tiles of ANCHORS x ROWS scores and, along the
vectors, into CHUNKS. A panel is the part of a block of vectors in one chunk. Panels go to the tiles that need them, each chunk of a
tile is multiplied in a task of its own, and the partial tiles of whole numbers are shuffled to the tile's owner, which multiplies the
last chunk itself and adds up. A tile is reduced at once to the few scores that count for each anchor; tiles are never stored.

Two such products: the first finds each anchor's positives, the best rows of its own label, over the tiles that hold
equal labels; the second finds, for each anchor and positive, the best rows of other labels within the window of scores
that the positive sets, over the tiles that hold different labels. Rows are laid into blocks along their labels, so a tile is
needed by both products only where labels meet. A label of any number of rows spreads over blocks by hash, so
tiles have about one size, however labels are dealt; the partial tops of an anchor are reduced in two steps.

Work and shuffled bytes are the product of anchors and rows, as the scores themselves are: two bytes a score and chunk
but the last, as long as partial scores fit in 16 bits, four and more beyond.

Entries times 256 are floored. Rows with a null id or label, a null or empty vector, a null or non-finite entry, or a length that is not
the usual one (the most frequent, of equals the largest) take no part. Repeated rows are rows of their own: each is an anchor, positive or
negative for itself, and no row is its own positive. Ties go to the smaller id. Anchors without positives, or without rows in a window,
give no rows; so does an empty table. Other columns are ignored. Scores must fit a long.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, running_sum, tidy
from .vector_rows import integer_rows, unpack, usual_dim

#: Anchors and rows of a tile, about, and into how many chunks vectors are cut.
ANCHORS, ROWS, CHUNKS = 256, 2048, 2
#: As many labels at most are broadcast to the rows; beyond it they are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Parts in which an anchor's tops of tiles are reduced first.
PARTS = 64
#: Positives, negatives of each, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
_LEAST = np.iinfo(np.int64).min
_PANEL = "block bigint, chunk int, entries binary, row binary, id binary, label binary, scores binary"
_TILE = "i bigint, j bigint, chunk int, role int, entries binary, row binary, id binary, label binary, scores binary"


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers, sign folded into the lowest bit, as planes of 16 bits; planes without a bit are left out."""
    folded = ((values << 1) ^ (values >> 63)).astype("<i8").view("<u2").reshape(-1, 4)
    planes = next((k for k in range(4, 1, -1) if folded[:, k - 1].any()), 1)
    return bytes([planes]) + np.ascontiguousarray(folded[:, :planes].T).tobytes()


def widen(raw: memoryview | pa.Buffer, shape: tuple[int, int]) -> np.ndarray:
    planes = int(np.frombuffer(raw, np.uint8, 1)[0])
    low = np.frombuffer(raw, "<u2", planes * shape[0] * shape[1], 1).reshape(planes, -1)
    folded = functools.reduce(lambda total, k: total | low[k].astype(np.uint64) << np.uint64(16 * k), range(planes), np.zeros(1, np.uint64))
    return ((folded >> np.uint64(1)).view(np.int64) ^ -(folded & np.uint64(1)).view(np.int64)).reshape(shape)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of whole numbers, exactly: in doubles where no sum can leave them."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 63:
        raise ValueError("inner products of the vectors may not fit a long")
    return a @ b.T


def best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (anchor, row) of the k highest allowed scores of each anchor, by falling score and rising id."""
    masked = np.where(allowed, scores, _LEAST)
    if masked.shape[1] > k:
        allowed = allowed & (masked >= np.partition(masked, -k, axis=1)[:, -k, None])
    at, to = np.nonzero(allowed)
    order = np.lexsort((to, ids[to], -scores[at, to], at))
    at, to = at[order], to[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], to[keep]


def _cuts(dim: int) -> list[int]:
    chunks = min(CHUNKS, dim)
    return [dim * k // chunks for k in range(chunks + 1)]


def _panels(dim: int, with_scores: bool):
    """The panels of each block of rows (block, row, id, label, x[, scores]) that lie together by block; the last chunk's has what rows are."""
    cuts = _cuts(dim)

    def panels(block: int, parts: list[pa.RecordBatch]) -> Iterator[tuple]:
        table = pa.Table.from_batches(parts).combine_chunks()
        x = unpack(table.column("x").chunk(0), dim)
        longs = [table.column(c).to_numpy().astype("<i8").tobytes() for c in ("row", "id", "label")]
        scores = None
        if with_scores:
            lists = table.column("scores").to_pylist()
            scores = np.array([[*s, *[_LEAST] * (POSITIVES - len(s))] for s in lists], "<i8").tobytes()
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            last = k == len(cuts) - 2
            yield (block, k, narrow(x[:, a:b].ravel()), *(longs if last else [None] * 3), scores if last else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        names = ["block", "chunk", "entries", "row", "id", "label", "scores"]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)
        block, parts = None, []
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)] if len(blocks) else [0]
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                if parts and blocks[a] != block:
                    yield batch_of(list(panels(block, parts)))
                    parts = []
                block = int(blocks[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield batch_of(list(panels(block, parts)))

    return run


def _panel(entries: pa.Scalar, width: int) -> np.ndarray:
    raw = entries.as_buffer()
    planes = int(np.frombuffer(raw, np.uint8, 1)[0])
    return widen(raw, ((raw.size - 1) // 2 // planes // width, width))


def _partial_tiles(dim: int):
    """The partial tile of each chunk from its two panels, which lie together, the anchors' first."""
    cuts = _cuts(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors = None, None
        for batch in batches:
            for i, j, k, role, entries in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
                panel = _panel(entries, cuts[k + 1] - cuts[k])
                if role == 0:
                    at, anchors = (i, j, k), panel
                    continue
                if at != (i, j, k):
                    raise RuntimeError(f"tile {i}, {j} has no anchors")
                tile = narrow(product(anchors, panel).ravel())
                none = pa.nulls(1, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([j], pa.int64()), pa.array([k], pa.int32()), pa.array([2], pa.int32()), pa.array([tile], pa.binary()), none, none, none, none], names=["i", "j", "chunk", "role", "entries", "row", "id", "label", "scores"])

    return run


def _tops(dim: int, negatives: bool):
    """(anchor, place, part, row, id, score): the tops of each tile, from its last panels and the partial tiles of the other chunks, which follow them.

    For positives place is 0; for negatives it is the place of the positive whose window holds the score.
    """
    cuts = _cuts(dim)
    width = cuts[-1] - cuts[-2]
    names = ["anchor", "place", "part", "row", "id", "score"]
    longs = lambda value: np.frombuffer(value.as_buffer(), "<i8")

    def tops(j: int, tile: np.ndarray, a: tuple, b: tuple) -> pa.RecordBatch:
        (_, a_row, _, a_label, a_scores), (_, b_row, b_id, b_label, _) = a, b
        same = a_label[:, None] == b_label
        found = []
        if not negatives:
            found.append((0, *best(tile, same & (a_row[:, None] != b_row), b_id, POSITIVES)))
        else:
            for place, column in enumerate(a_scores.reshape(-1, POSITIVES).T):
                low = np.array([-(-LOW * s // 100) for s in column.tolist()], object)
                high = np.array([HIGH * s // 100 for s in column.tolist()], object)
                here = np.flatnonzero((column != _LEAST) & (low <= high))
                if len(here):
                    some = tile[here]
                    within = (some >= low[here].astype(np.int64)[:, None]) & (some <= high[here].astype(np.int64)[:, None]) & ~same[here]
                    at, to = best(some, within, b_id, NEGATIVES)
                    found.append((place, here[at], to))
        at, to = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (1, 2))
        places = np.concatenate([np.full(len(f[1]), f[0], np.int32) for f in found]) if found else np.zeros(0, np.int32)
        columns = (a_row[at], places, np.full(len(at), j % PARTS, np.int32), b_row[to], b_id[to], tile[at, to])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, a, b, tile, due = None, None, None, None, 0
        for batch in batches:
            for i, j, role, row in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), range(batch.num_rows), strict=True):
                if role == 0:
                    at, b = (i, j), None
                    a = (_panel(batch.column(4)[row], width), *(longs(batch.column(c)[row]) for c in (5, 6, 7)), longs(batch.column(8)[row]) if negatives else None)
                    continue
                if at != (i, j):
                    raise RuntimeError(f"tile {i}, {j} has no anchors")
                if role == 1:
                    b = (_panel(batch.column(4)[row], width), *(longs(batch.column(c)[row]) for c in (5, 6, 7)), None)
                    tile, due = product(a[0], b[0]), len(cuts) - 2
                else:
                    tile = tile + widen(batch.column(4)[row].as_buffer(), tile.shape)
                    due -= 1
                if not due:
                    yield tops(j, tile, a, b)

    return run


def _scored(anchors: DataFrame, rows: DataFrame, tiles: DataFrame, dim: int, negatives: bool) -> DataFrame:
    """Tops of the given tiles (i, j) from the panels of anchors and rows."""
    last = len(_cuts(dim)) - 2
    rest = ("chunk", "entries", "row", "id", "label", "scores")
    sides = [panels.withColumnRenamed("block", end).join(tiles, end).select("i", "j", F.lit(role).alias("role"), *rest) for role, (panels, end) in enumerate(((anchors, "i"), (rows, "j")))]
    both = sides[0].unionByName(sides[1]).select("i", "j", "chunk", "role", *rest[1:])
    partial = both.where(F.col("chunk") < last).repartition("i", "j", "chunk").sortWithinPartitions("i", "j", "chunk", "role").mapInArrow(tidy(_partial_tiles(dim)), _TILE)
    owned = both.where(F.col("chunk") == last).unionByName(partial).repartition("i", "j").sortWithinPartitions("i", "j", "role")
    return owned.mapInArrow(tidy(_tops(dim, negatives)), "anchor bigint, place int, part int, row bigint, id bigint, score bigint")


def _first(tops: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and place, numbered from 1 by rank; first within parts of the tiles."""
    for by in (["anchor", "place", "part"], ["anchor", "place"]):
        tops = tops.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row"))).where(F.col("rank") <= k)
    return tops.drop("part")


def _blocks(rows: DataFrame, start: str, count: str, each: int) -> Column:
    """The block of a row: somewhere among its label's places, by hash."""
    somewhere = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor((F.col(start) + somewhere * F.col(count)) / each).cast("bigint")


def mine(vectors: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hard negatives of every anchor and positive."""
    label = F.col(label) if isinstance(label, str) else label
    named = vectors.select(F.col(id_column).cast("bigint").alias("id"), label.alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("vector"))
    rows = checkpoint(integer_rows(named.where("id is not null and label is not null"), "vector", ["id", "label", "anchor"]).withColumn("row", F.monotonically_increasing_id()))
    dim = usual_dim(rows)
    rows = rows.where(F.col("dim") == dim).drop("dim")
    # labels one after the other, each as long as it has rows
    labels = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).withColumn("hash", F.xxhash64("label"))
    for count in ("rows", "anchors"):
        labels = running_sum(labels, [], F.shiftright("hash", 50), [F.col("hash"), F.col("label")], F.col(count), f"{count}_upto")
    labels = checkpoint(labels.select(F.col("label").alias("_label"), *["rows", "anchors"], *[(F.col(f"{c}_upto") - F.col(c)).alias(f"{c}_start") for c in ("rows", "anchors")], F.col("anchors_upto_total")))
    known = labels.agg(F.count(F.lit(1)), F.max("anchors_upto_total")).first()
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not known[1]:
        return vectors.sparkSession.createDataFrame([], result)
    placed = rows.join(F.broadcast(labels) if known[0] <= BROADCAST_LABELS else labels, F.col("label") == F.col("_label"))
    placed = placed.select("row", "id", F.col("rows_start").alias("label"), "x", "anchor", _blocks(placed, "rows_start", "rows", ROWS).alias("j"), F.when(F.col("anchor"), _blocks(placed, "anchors_start", "anchors", ANCHORS)).alias("i"))
    placed = checkpoint(placed)
    anchors = placed.where("anchor").select(F.col("i").alias("block"), "row", "id", "label", "x")
    most = -(-known[1] // ANCHORS)

    def panels(some: DataFrame, with_scores: bool) -> DataFrame:
        names = ["block", "row", "id", "label", "x", *["scores"] * with_scores]
        return checkpoint(some.select(*names).repartition("block").sortWithinPartitions("block", "row").mapInArrow(tidy(_panels(dim, with_scores)), _PANEL))

    all_rows = panels(placed.withColumnRenamed("j", "block"), False)
    theirs, ours = placed.select("j", "label").distinct(), placed.where("anchor").select("i", "label").distinct()
    alike = ours.join(theirs, "label").select("i", "j").distinct()
    positives = checkpoint(_first(_scored(panels(anchors, False), all_rows, alike, dim, False), POSITIVES).withColumn("place", F.col("rank") - 1))

    scores = positives.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("scores"))
    span = lambda side, end: side.groupBy(end).agg(F.min("label").alias(f"{end}_low"), F.max("label").alias(f"{end}_high"))
    unlike = span(theirs, "j").withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(most - 1).cast("bigint")))).join(span(ours, "i"), "i")
    unlike = unlike.where("not (i_low = i_high and j_low = j_high and i_low = j_low)").select("i", "j")
    negatives = _first(_scored(panels(anchors.join(scores, "row"), True), all_rows, unlike, dim, True), NEGATIVES)
    of = positives.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    found = negatives.select("anchor", "place", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(of, ["anchor", "place"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
