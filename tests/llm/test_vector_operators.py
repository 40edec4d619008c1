"""Whitening, SimHash groups and hard negatives against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpuscle.llm import negatives, simhash, whitening
from corpuscle.llm.vector_rows import SCALE, integer_rows, pack, unpack

VECTORS = "vec_id bigint, embedding array<double>, label int, x string, row string"  # extra columns with clashing names


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)


def integers(v):
    """The row's entries as whole numbers, or None where it takes no part."""
    return None if not v or any(c is None or not math.isfinite(c) for c in v) else [math.floor(SCALE * c) for c in v]


# packed vectors


def test_packed_vectors_come_back_in_any_width():
    import pyarrow as pa

    rows = [[0, 1, -1], [32767, -32768, 5], [32768, 0, 0], [-(2**40), 2**40, 7], [0, 0, 0]]
    for some in ([rows[0], rows[4]], rows):
        assert unpack(pa.array([pack(np.array(r)) for r in some], pa.binary()), 3).tolist() == some
    assert pack(np.array([1, 2])) == pack(np.array([1, 2], np.int64)) != pack(np.array([2, 1]))


def test_rows_that_take_no_part(spark):
    rows = [(1, [0.5, -0.001], 0), (2, None, 0), (3, [], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0), (7, [1e30, 0.0], 0), (None, [0.1, 0.2], 0)]
    got = integer_rows(vectors_of(spark, rows), "embedding", ["vec_id"]).orderBy("vec_id").collect()
    assert [(r.vec_id, r.dim) for r in got] == [(None, 2), (1, 2)]
    assert np.frombuffer(got[1].x, "<i2", 2, 1).tolist() == [128, -1]


# whitening


def brute_whitening(rows, k):
    x = np.array([integers(v) for _, v, _ in rows], np.int64)
    unique = np.unique(x, axis=0)
    n, sums = len(unique), unique.sum(0)
    centred = unique - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize(("dim", "n", "flat"), [(5, 60, True), (64, 300, True), (48, 400, False)])
def test_whitening_matches_eigenvectors(spark, dim, n, flat):
    rng = np.random.default_rng(dim)
    scales = np.ones(dim) if flat else 0.7 ** np.arange(dim)
    base = rng.standard_normal((n, dim)) * scales + 3 * rng.standard_normal(dim)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)]
    rows += [(1000 + i, base[0].tolist(), 1) for i in range(n // 2)]  # a third are copies of one vector
    size, deviation, white, explained = brute_whitening(rows, 4)
    got = whitening.components(vectors_of(spark, rows + [(5000, [math.nan] * dim, 0), (5001, [1.0], 0), (5002, None, 0)])).toPandas()
    assert len(got) == 4 * len(rows) and set(got.n) == {size} and got.identity_error.max() < 1e-9
    order = [r[0] for r in rows]
    for c in range(4):
        mine = got[got.component == c + 1].set_index("vec_id").loc[order]
        assert (mine.deviation.to_numpy() == deviation).all()
        assert min(np.abs(mine.whitened - white[:, c]).max(), np.abs(mine.whitened + white[:, c]).max()) < 1e-7
        assert abs(mine.explained.iloc[0] / explained[c] - 1) < 1e-9


def test_whitening_leaves_out_components_without_variance(spark):
    line = [(i, [i / 4, -i / 2, 1.0], 0) for i in range(9)]
    got = whitening.components(vectors_of(spark, line)).toPandas()
    assert set(got.component) == {1} and len(got) == 9 and abs(got.explained.iloc[0] - 1) < 1e-9
    assert whitening.components(vectors_of(spark, [(1, [0.5, 0.5], 0)] * 3)).count() == 0
    assert whitening.components(vectors_of(spark, [])).count() == 0
    assert whitening.components(vectors_of(spark, [(1, None, 0)])).count() == 0


def test_whitening_is_exact_beyond_long_products(spark):
    rows = [(1, [2.0**40, 0.0], 0), (2, [-(2.0**40), 1.0], 0), (3, [0.0, 2.0], 0)]
    got = whitening.components(vectors_of(spark, rows)).where("component = 1").orderBy("vec_id").collect()
    want = [sum((3 * v - s) ** 2 for v, s in zip(integers(r[1]), (0, 768), strict=True)) for r in rows]
    assert [r.deviation for r in got] == [w if w < 2**63 else None for w in want]


# SimHash


def brute_fingerprint(text, n=3):
    lower = {c: c + 32 for c in range(65, 91)}
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[find(j)] = find(i)
    return [min((ids[j] for j in range(len(ids)) if find(j) == find(i) and ids[j] is not None), default=None) for i in range(len(ids))]


def test_golay_decoding_is_nearest_and_single_errors_share_codes():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 2000, dtype=np.int32)
    codewords = np.array([m << 11 | simhash._remainder(m << 11) for m in range(1 << 12)], np.int32)
    assert min((int(a) ^ int(b)).bit_count() for a, b in zip(codewords[:-1], codewords[1:], strict=True)) >= 7
    got = simhash.decode(words)
    assert np.bitwise_count(codewords[got] ^ words).max() <= 3
    prints = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    flipped = prints ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    for (code, _), (_, near) in zip(simhash.segment_codes(prints), simhash.segment_codes(flipped), strict=True):
        assert (code[:, None] == near).any(1).all()


def test_any_three_errors_leave_a_shared_key():
    import pyarrow as pa

    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(400)]
    other = [b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(4))) for b in base]
    keys = [next(simhash._keys([pa.RecordBatch.from_pydict({"print": pa.array(np.array(p, np.uint64).view(np.int64))})])) for p in (base, other)]
    for left, right in zip(keys[0].column(1).to_pylist(), keys[1].column(2).to_pylist(), strict=True):
        assert set(left) & set(right)
    assert max(map(len, keys[0].column(1).to_pylist())) <= 18


def test_fingerprints_of_pieces_match_whole_texts(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["Ä", "Die", "B", "naïve", "x\ty", "\x0b"]) + str(rng.randrange(50)) for _ in range(300))
    want = brute_fingerprint(text)
    assert simhash.fingerprint(text) == want
    monkeypatch.setattr(simhash, "PIECE", 7)
    monkeypatch.setattr(simhash, "BLOCK", 5)
    assert simhash.fingerprint(text) == want
    for short in ("", " \n", "One", "one TWO", "a b c"):
        assert simhash.fingerprint(short) == brute_fingerprint(short)


def simhash_case(rng):
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for _ in range(30):
        words = [word() for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    return rows + ["", None, " ", "one", "One", "one two"]


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_groups_match_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = simhash_case(rng)
    texts += [texts[0]] * 40  # one text many times
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, print int, key string")
    prints = [brute_fingerprint(t) for t in texts]
    want = dict(zip(ids, zip((f"{p:016x}" for p in prints), brute_components(prints, ids), strict=True), strict=True))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digests(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(set(prints))  # some link without being equal


def test_simhash_dense_group_is_one_component(spark, monkeypatch):
    """Fingerprints all around one point, of which only neighbours link, and a chain."""
    rng = random.Random(4)
    center = rng.getrandbits(64)
    prints = list({center ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(5))) for _ in range(300)})
    chain = [rng.getrandbits(64)]
    for _ in range(12):
        chain.append(chain[-1] ^ sum(1 << p for p in rng.sample(range(64), 3)))
    prints += chain
    monkeypatch.setattr(simhash, "_fingerprints", lambda n: _stored)
    docs = spark.createDataFrame([(i, str(p)) for i, p in enumerate(prints)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert [got[i] for i in range(len(prints))] == brute_components(prints, list(range(len(prints))))


def _stored(batches):
    import pyarrow as pa

    for batch in batches:
        values = np.array([int(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "print": pa.array(values), "task": pa.array([0] * len(values), pa.int32())})


def test_simhash_of_nothing_and_of_rows_without_or_with_repeated_ids(spark):
    assert simhash.digests(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (None, "zz yy xx"), (4, "a b c d"), (4, "q r s t u"), (2, "q r s t u")], "doc_id bigint, text string")
    got = sorted(simhash.digests(docs).select("doc_id", "component_id").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(None, 4), (None, None), (4, 4), (4, 2), (2, 2)], key=str)


# hard negatives


def brute_negatives(rows):
    rows = [(i, integers(v), label) for i, v, label in rows if i is not None and label is not None and integers(v)]
    dims = [len(v) for _, v, _ in rows]
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows if len(v) == dim]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a, (i, v, label) in enumerate(rows):
        if i % 50:
            continue
        scored = sorted((-score(v, w), j, m == label) for b, (j, w, m) in enumerate(rows) if a != b)
        for p, j, same in [s for s in scored if s[2]][:5]:
            fit = [(n, k) for n, k, alike in scored if not alike and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(i, j, rank + 1, k, -p, -n) for rank, (n, k) in enumerate(fit)]
        del same
    return sorted(out)


def mined(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 50 == 0, label=label).collect()))


def test_negatives_match_brute_force_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "ROWS", 40)
    rng = np.random.default_rng(7)
    centers = rng.standard_normal((10, 9))
    rows = []
    for i in range(420):
        label = 0 if i % 3 == 0 else int(rng.integers(10))  # a third has one label
        v = 0.2 * rng.standard_normal(9) + centers[label] * rng.integers(0, 2) * 0.1
        rows.append((i, np.round(v, 1).tolist(), label))  # rounded, so that scores tie
    rows += [(5000, [0.1] * 9, None), (5050, None, 1), (5100, [math.nan] * 9, 1), (5150, [0.1], 1), (None, [0.1] * 9, 1), (5200, [None] * 9, 2)]
    want = brute_negatives(rows)
    assert len(want) > 60 and mined(spark, rows) == want


def test_negatives_of_wide_scores_of_one_dimension_and_of_nothing(spark):
    rng = np.random.default_rng(2)
    wide = [(10 * i, (1000 * rng.standard_normal(4)).tolist(), i % 3) for i in range(60)]
    assert mined(spark, wide) == brute_negatives(wide) != []
    single = [(10 * i, [float(rng.standard_normal())], i % 2) for i in range(60)]
    assert mined(spark, single) == brute_negatives(single)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(50, [1.0], 1), (51, [0.7], 2)]) == []


def test_narrow_tiles_come_back(spark):
    rng = np.random.default_rng(1)
    for most in (1, 30_000, 40_000, 1 << 20, 1 << 40, (1 << 62)):
        values = rng.integers(-most, most, (5, 7), endpoint=True)
        raw = negatives.narrow(values.ravel())
        assert (negatives.widen(memoryview(raw), (5, 7)) == values).all()
    assert len(negatives.narrow(np.arange(-100, 100))) == 401
    assert (negatives.product(np.array([[1 << 30]]), np.array([[1 << 30]])) == 1 << 60).all()
    with pytest.raises(ValueError):
        negatives.product(np.array([[1 << 33]]), np.array([[1 << 33]]))
