"""Vector operators over array columns: expressions for single vectors, blocks of matrices for searches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

BLOCK = 1024
#: Scores of queries by rows that a task holds at a time.
CELLS = 1 << 22
#: Visits of vectors to cells that a task hands on at a time.
VISITS = 1 << 16
#: Blocks of one cell that meet the cell's blocks in one task.
MET = 8
#: Pairs whose exact products a task takes at a time.
PAIRS = 1 << 16
#: Rows of a strip of keys, where there are strips enough, and scores that a tile of two strips holds at a time.
STRIP, SCORES = 32_768, 1 << 20
#: Query vectors of as many bytes at most are broadcast.
BROADCAST_BYTES = 32 << 20


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row; a lambda of a higher-order function would compute it for each entry."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalise(v: Column) -> Column:
    """Divided by its length; a zero vector stays zero."""
    return _once(doubles(v), lambda d: _once(F.greatest(norm(d), F.lit(1e-9)), lambda size: F.transform(d, lambda x: x / size)))


def rounded(x: Column) -> Column:
    """Rounded to 6 digits, with the sign of what rounds to zero, as floating-point rounding has it; F.round goes through decimals and loses it."""
    near = F.round(x, 6)
    return F.when(near == 0, x * F.lit(0.0)).otherwise(near)


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def mean(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: (x + y) / 2)


def weighted_mean(a: Column, la: Column, b: Column, lb: Column) -> Column:
    """Mean weighted by lengths, of length 1."""
    return normalise(F.zip_with(doubles(a), doubles(b), lambda x, y: (x * la + y * lb) / (la + lb)))


def quantise(v: Column, levels: int) -> Column:
    """Struct of codes 0..levels (half to even), scale and offset of one vector."""
    low, high = F.array_min(doubles(v)), F.array_max(doubles(v))
    scale = F.when(high > low, (high - low) / levels).otherwise(F.lit(1.0))
    code = lambda b: F.transform(doubles(v), lambda x: F.rint((x - b["offset"]) / b["scale"]).cast("int"))
    return _once(F.struct(scale.alias("scale"), low.alias("offset")), lambda b: F.struct(code(b).alias("codes"), b["scale"].alias("scale"), b["offset"].alias("offset")))


def dequantise(q: Column) -> Column:
    return _once(q, lambda known: F.transform(known["codes"], lambda c: c * known["scale"] + known["offset"]))


def subspace_code(v: Column, parts: int, size: int) -> Column:
    """For each slice, the place of the value nearest to the slice's mean, mod 256."""
    step = size // parts

    def one(i: int) -> Column:
        piece = F.slice(doubles(v), i * step + 1, step)
        middle = F.aggregate(piece, F.lit(0.0), lambda s, x: s + x) / step
        off = F.transform(piece, lambda x: F.round(F.abs(x - middle), 9))
        return ((F.array_position(off, F.array_min(off)) - 1) % 256).cast("int")

    return F.array(*[one(i) for i in range(parts)])


def _blocks(df: DataFrame, key: str, vector: str, prefix: str, cell: str | None = None) -> DataFrame:
    """Rows of up to BLOCK vectors each: ids and their float matrix as binary. Partitions are blocked where they are, by cell if there is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, rows in batch.groupby(cell) if cell else [(None, batch)]:
                for at in range(0, len(rows), BLOCK):
                    part = rows.iloc[at : at + BLOCK]
                    out = {f"{prefix}_ids": [part[key].tolist()], f"{prefix}_rows": [np.stack(part[vector]).astype(np.float64).tobytes()]}
                    yield pd.DataFrame(({cell: [where]} if cell else {}) | out)

    return df.select(key, vector, *[cell] * bool(cell)).where(F.col(vector).isNotNull()).mapInPandas(run, f"{f'{cell} int, ' if cell else ''}{prefix}_ids array<bigint>, {prefix}_rows binary")


def _first_k(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each row, by falling score and rising id."""
    order = np.lexsort((ids, -scores, row))
    first = np.searchsorted(row[order], row[order])
    return order[np.arange(len(order)) - first < k]


def _tops(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, score) of the k best rows of each query, for some queries at a time, so that no more than SCORES scores are held."""
    step = max(1, SCORES // max(1, len(rows)))
    for at in range(0, len(queries), step):
        scores = np.round(queries[at : at + step] @ rows.T, 6)
        if scores.shape[1] > k:
            query, place = np.nonzero(scores >= np.partition(scores, -k, axis=1)[:, -k, None])
        else:
            query, place = (x.ravel() for x in np.indices(scores.shape))
        value = scores[query, place]
        best = _first_k(query, ids[place], value, k)
        yield query[best] + at, ids[place[best]], value[best]


def dense_topk(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, doc_id, score (6 digits), rank: the k largest inner products of each query with the whole corpus.

    Queries of up to ``most_bytes`` together are broadcast as one matrix, and each partition of the corpus keeps its k best of
    each; beyond it blocks of queries meet blocks of the corpus. A window picks from the candidates. Ties: the smaller doc_id.
    """
    asked = queries.select(key, vector).where(F.col(vector).isNotNull())
    size = asked.agg(F.sum(F.size(vector) * F.lit(8))).first()[0] or 0
    if size <= most_bytes:
        rows = asked.toPandas()
        known = corpus.sparkSession.sparkContext.broadcast((rows[key].to_numpy(), np.stack(rows[vector]).astype(float) if len(rows) else np.zeros((0, 1))))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = known.value
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for batch in batches:
                if len(batch) and len(names):
                    found = [best, *_tops(q, np.stack(batch[vector]).astype(float), batch[key].to_numpy(), k)]
                    best = tuple(np.concatenate([f[i] for f in found]) for i in range(3))
                    keep = _first_k(*best, k)
                    best = tuple(b[keep] for b in best)
            yield pd.DataFrame({"query_id": names[best[0]] if len(names) else best[0], "doc_id": best[1], "score": best[2]})

        found = corpus.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(scan, "query_id bigint, doc_id bigint, score double")
    else:
        found = _block_pairs(corpus, asked, key, vector).mapInPandas(_meet(k), "query_id bigint, doc_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _meet(k: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                q, c = (np.frombuffer(x, np.float64).reshape(len(i), -1) for x, i in ((row.q_rows, row.q_ids), (row.c_rows, row.c_ids)))
                asked = np.asarray(row.q_ids)
                for query, ids, scores in _tops(q, c, np.asarray(row.c_ids), k):
                    yield pd.DataFrame({"query_id": asked[query], "doc_id": ids, "score": scores})

    return run


def _block_pairs(corpus: DataFrame, queries: DataFrame, key: str, vector: str) -> DataFrame:
    """Every block of queries with every block of the corpus; blocks, not rows, are paired, over as many salts as shuffles have partitions."""
    salts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = _blocks(corpus, key, vector, "c").withColumn("salt", F.pmod(F.xxhash64("c_ids"), F.lit(salts)))
    q = _blocks(queries, key, vector, "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return c.join(q, "salt").drop("salt")


def _tiles(df: DataFrame, key: str, vector: str) -> tuple[GroupedData, Callable]:
    """Rows (asks, ids, rows) by tile: keys are cut into strips of neighbouring ones, each strip asks (asks) those before it and itself. And how their blocks are read:
    ids and unit vectors of each. A strip is shuffled once for each strip; vectors that have no direction or no key are left out."""
    kind = "float" if dict(df.dtypes)[vector] == "array<float>" else "double"
    size = norm(F.col(vector))
    unit = df.where((size > 0) & (size < float("inf")) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("_id"), F.col(vector).cast(f"array<{kind}>").alias("_v"))
    n = unit.count()
    strips = max(-(-n // STRIP), min(8, -(-n // BLOCK)), 1)
    borders = np.array(unit.approxQuantile("_id", [i / strips for i in range(1, strips)], 0.1 / strips) if strips > 1 else [])
    held = np.float32 if kind == "float" else np.float64

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for strip, rows in batch.groupby(np.searchsorted(borders, batch["_id"].to_numpy(), side="right"), sort=False):
                yield pd.DataFrame({"strip": [np.int32(strip)], "ids": [rows["_id"].to_numpy().tobytes()], "rows": [np.stack(rows["_v"]).astype(held).tobytes()]})

    blocks = unit.repartitionByRange(2 * strips, "_id").sortWithinPartitions("_id").mapInPandas(block, "strip int, ids binary, rows binary")
    tiles = lambda asks: F.explode(F.sequence(F.lit(0), F.col("strip")) if asks else F.sequence(F.col("strip"), F.lit(strips - 1)))
    asked = blocks.withColumn("other", tiles(True)).select(F.col("strip").alias("q"), F.col("other").alias("c"), F.lit(True).alias("asks"), "ids", "rows")
    there = blocks.withColumn("other", tiles(False)).select(F.col("other").alias("q"), F.col("strip").alias("c"), F.lit(False).alias("asks"), "ids", "rows")

    def parts(some: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for ids, raw in zip(some["ids"], some["rows"], strict=True):
            v = np.frombuffer(raw, held).reshape(len(ids) // 8, -1).astype(np.float64)
            yield np.frombuffer(ids, np.int64), v / np.sqrt((v * v).sum(1, keepdims=True))

    return asked.unionByName(there).repartition(strips * (strips + 1) // 2, "q", "c").groupBy("q", "c"), parts


def _scores(tile: pd.DataFrame, parts: Callable, threshold: float) -> Iterator[tuple]:
    """(ids, vectors) of some that ask and of some before them, their products in single precision (-2 where the key is not smaller), and by how much these may be off."""
    known = list(parts(tile[~tile["asks"]]))
    if not known:
        return
    ids, rows = (np.concatenate([k[i] for k in known]) for i in range(2))
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    low, slack = rows.astype(np.float32), 1e-6 + 1.5e-7 * (rows.shape[1] + 4)
    for names, q in parts(tile[tile["asks"]]):
        step = max(1, SCORES // len(q))
        for at in range(0, np.searchsorted(ids, names.max()), step):
            c = ids[at : at + step]
            scores = q.astype(np.float32) @ low[at : at + step].T
            if c[-1] >= names.min():
                scores[c[None] >= names[:, None]] = -2.0
            yield (names, q), (c, rows[at : at + step]), scores, slack


def _pairs_in_tiles(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    met, parts = _tiles(df, key, vector)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (b, y), (a, x), scores, slack in _scores(pd.concat(list(batches)), parts, threshold):
            near = np.flatnonzero(scores.ravel() >= max(threshold - slack, -1.5))
            for at in range(0, len(near), PAIRS):
                i, j = np.divmod(near[at : at + PAIRS], len(a))
                exact = np.round((y[i] * x[j]).sum(1), 6)
                keep = exact >= threshold
                yield pd.DataFrame({"a": a[j[keep]], "b": b[i[keep]], "cosine": exact[keep]})

    return met.applyInPandas(meet, "a bigint, b bigint, cosine double")


def earlier_counts(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """b, earlier: how many rows with a smaller key have a cosine of the threshold or more (6 digits), where there is one.

    Tiles as in nearest_earlier count where they are, so no list of pairs is made. Products in single precision tell most pairs; those too near to the
    threshold are taken exactly.
    """
    met, parts = _tiles(df, key, vector)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (b, y), (a, x), scores, slack in _scores(pd.concat(list(batches)), parts, threshold):
            sure = np.count_nonzero(scores >= max(threshold + slack, -1.5), axis=1)
            open_ = np.flatnonzero((scores.ravel() >= max(threshold - slack, -1.5)) & (scores.ravel() < threshold + slack))
            for at in range(0, len(open_), PAIRS):
                i, j = np.divmod(open_[at : at + PAIRS], len(a))
                sure = sure + np.bincount(i[np.round((y[i] * x[j]).sum(1), 6) >= threshold], minlength=len(b))
            yield pd.DataFrame({"b": b[sure > 0], "earlier": sure[sure > 0]})

    return met.applyInPandas(meet, "b bigint, earlier bigint").groupBy("b").agg(F.sum("earlier").alias("earlier"))


def similar_pairs(df: DataFrame, key: str, vector: str, threshold: float, cells: int | None = None, seed: int = 7) -> DataFrame:
    """a < b with cosine of the threshold or more, and the cosine (6 digits). Vectors of length 0 are similar to none.

    Unit vectors so near are at most r = sqrt(2 - 2 t) apart. Each vector lies in the cell of the nearest of a few of them,
    the centres (chosen by a hash of the key, a bounded number). A vector within r of one of another cell is no further than r
    from the plane between the two cells, so it visits the cells (of a higher number) whose plane is that near, and each pair
    meets in one cell. Within a cell, blocks of vectors meet as matrices; a large cell is many blocks. No pair is lost. At the
    thresholds of near duplicates few vectors visit another cell. No plane is further than 1 from a unit vector, so at thresholds of
    a half or less each would visit every cell: there strips of keys meet as tiles instead, unless ``cells`` are given.
    """
    spark = df.sparkSession
    least = threshold - 5e-7  # cosines are compared after rounding
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    if cells is None and reach >= 1:
        return _pairs_in_tiles(df, key, vector, threshold)
    unit = df.where(norm(F.col(vector)) > 0).select(F.col(key).cast("bigint").alias("_id"), normalise(F.col(vector)).alias("_v"))
    if cells is None:
        cells = int(min(1024, max(1, df.count() // (2 * BLOCK))))
    hashed = unit.select("_v", F.xxhash64("_id", F.lit(seed)).alias("_h"), "_id")
    centres = [r["_v"] for r in hashed.orderBy("_h", "_id").limit(cells).collect()]
    if not centres:
        return spark.createDataFrame([], f"a {dict(df.dtypes)[key]}, b {dict(df.dtypes)[key]}, cosine double")
    c = np.unique(np.array(centres, float), axis=0)
    apart = np.maximum(np.linalg.norm(c[:, None] - c[None], axis=2), 1e-12)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, VISITS // len(c))  # a row may visit every cell
        for batch in (b.iloc[at : at + step] for b in batches for at in range(0, len(b), step)):
            if len(batch):
                off = 2 - 2 * np.stack(batch["_v"]) @ c.T
                own = off.argmin(1)
                plane = (off - off.min(1, keepdims=True)) / (2 * apart[own])
                row, cell = np.nonzero((plane <= reach) & (np.arange(len(c)) > own[:, None]))
                ids, vectors = batch["_id"].to_numpy(), batch["_v"].to_numpy()
                at = np.concatenate([np.arange(len(batch)), row])
                yield pd.DataFrame({"cell": np.concatenate([own, cell]).astype(np.int32), "visits": np.arange(len(at)) >= len(batch), "_id": ids[at], "_v": vectors[at]})

    placed = unit.mapInPandas(place, "cell int, visits boolean, _id bigint, _v array<double>")
    placed = placed.repartition("cell", F.pmod(F.xxhash64("_id"), F.lit(64))).sortWithinPartitions("cell", "_id")
    own = _blocks(placed.where("not visits"), "_id", "_v", "a", "cell")
    guests = _blocks(placed.where("visits"), "_id", "_v", "b", "cell").withColumn("guest", F.lit(True))
    # the blocks that a cell's blocks meet are dealt over salts, so that a large cell is many tasks' work
    met = own.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MET).cast("int").alias("salts"))  # a row a cell
    own = own.join(F.broadcast(met), "cell").withColumn("salt", F.pmod(F.xxhash64("a_ids"), F.col("salts")).cast("int"))
    hosts = own.select("cell", F.col("a_ids").alias("b_ids"), F.col("a_rows").alias("b_rows"), F.lit(False).alias("guest"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x, y = (np.frombuffer(r, np.float64).reshape(len(i), -1) for r, i in ((row.a_rows, row.a_ids), (row.b_rows, row.b_ids)))
                one, other = np.asarray(row.a_ids), np.asarray(row.b_ids)
                first, second = np.nonzero(x @ y.T >= least - 1e-9)
                for at in range(0, len(first), PAIRS):
                    i, j = first[at : at + PAIRS], second[at : at + PAIRS]
                    scores = np.round((x[i] * y[j]).sum(1), 6)
                    keep = (scores >= threshold) & ((one[i] != other[j]) if row.guest else (one[i] < other[j]))
                    p, q = one[i][keep], other[j][keep]
                    yield pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q), "cosine": scores[keep]})

    both = hosts.unionByName(guests).join(F.broadcast(met), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return own.join(both, ["cell", "salt"]).select("a_ids", "a_rows", "b_ids", "b_rows", "guest").mapInPandas(meet, "a bigint, b bigint, cosine double")


def nearest_earlier(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """b, a, cosine (6 digits): for each row the most similar of those with a smaller key, of the threshold or more; of equals the smallest key.

    Keys are cut into strips of neighbouring ones, each strip meets those before it and itself as matrices, and such a tile keeps one row a
    vector: no list of pairs is made, and copies cost no more than others. A task holds two strips and a bounded block of scores. Products
    grow with the square of the table, and shuffled rows with it over the size of a strip.
    """
    met, parts = _tiles(df, key, vector)

    def meet(tile: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"b": np.zeros(0, np.int64), "a": np.zeros(0, np.int64), "cosine": np.zeros(0)})]
        known = list(parts(tile[~tile["asks"]]))
        if known:
            ids, rows = (np.concatenate([k[i] for k in known]) for i in range(2))
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], rows[order]
            for names, q in parts(tile[tile["asks"]]):
                best, of = np.full(len(q), -2.0), np.zeros(len(q), np.int64)
                step = max(1, SCORES // len(q))
                for at in range(0, np.searchsorted(ids, names.max()), step):
                    c = ids[at : at + step]
                    scores = q @ rows[at : at + step].T
                    if c[-1] >= names.min():
                        scores[c[None] >= names[:, None]] = -2.0
                    top = scores.max(1)
                    hit = np.flatnonzero(top >= max(threshold, -1.5) - 1e-6)
                    near = scores[hit] >= top[hit, None] - 1.5e-6
                    value = np.where(near, np.round(scores[hit], 6), -2.0) if len(hit) else near.astype(float)
                    place = value.argmax(1) if len(hit) else hit  # the first, so the smallest key
                    value = value[np.arange(len(hit)), place] if len(hit) else hit.astype(float)
                    more = (value >= threshold) & (value > best[hit])
                    best[hit[more]], of[hit[more]] = value[more], c[place[more]]
                found = best > -2
                out.append(pd.DataFrame({"b": names[found], "a": of[found], "cosine": best[found]}))
        return pd.concat(out)

    met = met.applyInPandas(meet, "b bigint, a bigint, cosine double")
    first = F.max(F.struct("cosine", (-F.col("a")).alias("n")))
    return met.groupBy("b").agg(first.alias("m")).select("b", (-F.col("m.n")).alias("a"), F.col("m.cosine").alias("cosine"))


def prune(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """Rows without any earlier similar row, whether that one stays or not."""
    gone = nearest_earlier(df, key, vector, threshold).select(F.col("b").alias(key))
    return df.join(gone, key, "left_anti")


def set_similarity(pairs: DataFrame, keys: list[str], one: str, other: str) -> DataFrame:
    """Mean cosine of the pairs of a group, 0 where there is none; pairs with a vector of length 0 do not count, unequal lengths count as 0."""
    counts = (norm(F.col(one)) > 0) & (norm(F.col(other)) > 0)
    value = F.when(F.size(one) != F.size(other), F.lit(0.0)).otherwise(cosine(F.col(one), F.col(other)))
    return pairs.groupBy(*keys).agg(F.round(F.coalesce(F.avg(F.when(counts, value)), F.lit(0.0)), 6).alias("similarity"))


def neighbours(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))


def hash_embed(df: DataFrame, text: str, out: str = "vector", size: int = 64) -> DataFrame:
    """``df`` with a deterministic stand-in for an embedding model: signed hashed term counts, of length 1."""
    import zlib

    from ..functions.text import index_tokens

    names = [f.name for f in df.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(len(names))
            words = terms.flatten().dictionary_encode()
            h = np.array([zlib.crc32(t.encode()) for t in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
            row = np.repeat(np.arange(len(batch)), terms.value_lengths().fill_null(0).to_numpy())
            v = np.bincount(row * size + h % size, np.where(h >> 16 & 1, 1.0, -1.0), len(batch) * size).reshape(len(batch), size)
            v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * size), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], vectors], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.select(*names, index_tokens(F.col(text)).alias("_terms")).mapInArrow(run, f"{fields}, {out} array<double>")


def cell_topk(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int, cells: int | None = None, sample: int = 20_000, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """As ``dense_topk``, with an inverted file of cells: only cells that can hold one of a query's k best are scanned.

    Centres are fitted by k-means on a bounded sample chosen by a hash of the key; every vector is indexed. A cell of centre
    m and radius r bounds inner products by q.m + |q| r. Each query's two most promising cells give a k-th score, and the
    cells whose bound reaches it are scanned, so the result is exact: recall is 1. Cells are scanned as matrices, by queries
    that are broadcast up to ``most_bytes`` and meet the cells in blocks beyond it; no row is made for a query and a cell.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    corpus = corpus.select(key, doubles(F.col(vector)).alias(vector)).where(F.col(vector).isNotNull())
    asked = queries.select(F.col(key).alias("query_id"), doubles(F.col(vector)).alias("q")).where(F.col("q").isNotNull())
    n = corpus.count()
    cells = cells or max(1, min(4096, int(4 * np.sqrt(n))))
    part = min(1.0, sample / max(1, n))
    few = corpus.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(part * 1_000_000)).select(array_to_vector(F.col(vector)).alias("features"))
    centres = np.array(KMeans(k=max(2, min(cells, few.count())), seed=1, maxIter=5, initMode="random").fit(few).clusterCenters()) if n > 1 else np.stack([np.asarray(r[0], float) for r in corpus.select(vector).collect()] or [np.zeros(1)])
    step = max(1, CELLS // len(centres))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), step):
                rows = batch.iloc[at : at + step]
                v = np.stack(rows[vector]).astype(float)
                cell = ((centres**2).sum(1) - 2 * v @ centres.T).argmin(1)
                yield pd.DataFrame({key: rows[key].to_numpy(), "cell": cell.astype(np.int32), "away": np.linalg.norm(v - centres[cell], axis=1), vector: list(v)})

    placed = corpus.mapInPandas(nearest, f"{key} {dict(corpus.dtypes)[key]}, cell int, away double, {vector} array<double>")
    reach = np.full(len(centres), -np.inf)
    for r in placed.groupBy("cell").agg(F.max("away").alias("r")).collect():  # one number a cell
        reach[r["cell"]] = r["r"]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), step):
                rows = batch.iloc[at : at + step]
                q = np.stack(rows["q"]).astype(float)
                bound = q @ centres.T + np.linalg.norm(q, axis=1, keepdims=True) * reach
                first = np.argsort(-np.where(np.isnan(bound), -np.inf, bound), 1)[:, :2]
                row = np.repeat(np.arange(len(q)), first.shape[1])
                yield pd.DataFrame({"query_id": rows["query_id"].to_numpy()[row], "cell": first.ravel().astype(np.int32), "q": list(q[row])})

    # ranges of cells: neighbouring rows are of one cell, and a cell of very many rows is many partitions
    blocks = _blocks(placed.repartitionByRange("cell", F.xxhash64(key)).sortWithinPartitions("cell"), key, vector, "c", "cell")
    probes = asked.mapInPandas(probe, "query_id bigint, cell int, q array<double>")
    firsts = _blocks(probes.repartitionByRange("cell", F.xxhash64("query_id")).sortWithinPartitions("cell"), "query_id", "q", "q", "cell")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    begun = firsts.join(blocks, "cell").select("q_ids", "q_rows", "c_ids", "c_rows").mapInPandas(_meet(k), "query_id bigint, doc_id bigint, score double")
    floor = begun.withColumn("_k", rank).where(F.col("_k") == k).select("query_id", F.col("score").alias("least"))
    known = asked.join(floor, "query_id", "left").select("query_id", "q", F.coalesce("least", F.lit(float("-inf"))).alias("least"))

    def found(kept: _Kept, q: np.ndarray, cell: int, ids: np.ndarray, rows: np.ndarray) -> None:
        bound = q @ centres[cell] + np.linalg.norm(q, axis=1) * reach[cell] + 1e-6
        use = np.nonzero(bound >= kept.least)[0]
        few = max(1, CELLS // max(1, len(rows)))
        for at in range(0, len(use), few):
            part = use[at : at + few]
            scores = np.round(q[part] @ rows.T, 6)
            i, j = np.nonzero(scores >= kept.least[part, None])
            kept.add(part[i], ids[j], scores[i, j])

    matrix = lambda raw, ids: np.frombuffer(raw, np.float64).reshape(len(ids), -1)
    size = asked.agg(F.sum(F.size("q") * F.lit(8))).first()[0] or 0
    if size <= most_bytes:
        rows = known.toPandas()
        shared = corpus.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(np.int64), np.stack(rows["q"]).astype(float) if len(rows) else np.zeros((0, centres.shape[1])), rows["least"].to_numpy(float)))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q, least = shared.value
            kept = _Kept(least, k)
            for batch in batches:
                for row in batch.itertuples(index=False):
                    found(kept, q, row.cell, np.asarray(row.c_ids), matrix(row.c_rows, row.c_ids))
            query, ids, scores = kept.best()
            for at in range(0, len(query), BLOCK * k):
                some = slice(at, at + BLOCK * k)
                yield pd.DataFrame({"query_id": names[query[some]], "doc_id": ids[some], "score": scores[some]})

        hits = blocks.mapInPandas(scan, "query_id bigint, doc_id bigint, score double")
    else:

        def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    q = matrix(row.q_rows, row.q_ids)
                    kept = _Kept(q[:, -1], k)
                    found(kept, q[:, :-1], row.cell, np.asarray(row.c_ids), matrix(row.c_rows, row.c_ids))
                    query, ids, scores = kept.best()
                    yield pd.DataFrame({"query_id": np.asarray(row.q_ids)[query], "doc_id": ids, "score": scores})

        salts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        q = _blocks(known.select("query_id", F.concat("q", F.array("least")).alias("q")), "query_id", "q", "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        c = blocks.withColumn("salt", F.pmod(F.xxhash64("c_ids"), F.lit(salts)))
        hits = c.join(q, "salt").select("cell", "c_ids", "c_rows", "q_ids", "q_rows").mapInPandas(pairs, "query_id bigint, doc_id bigint, score double")
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


class _Kept:
    """The k best rows of each query so far; ``least`` is the score that a row needs."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k, self.held = np.array(least, float), k, 0
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((query, ids, scores))
        self.held += len(query)
        if self.held > CELLS // 4:
            query, _, scores = self.best()
            full = np.nonzero(np.bincount(query, minlength=len(self.least)) >= self.k)[0]
            last = np.full(len(self.least), np.inf)
            np.minimum.at(last, query, scores)
            self.least[full] = np.maximum(self.least[full], last[full])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, scores = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        keep = _first_k(query, ids, scores, self.k)
        self.parts, self.held = [(query[keep], ids[keep], scores[keep])], 0
        return self.parts[0]
