"""Fusion, vectors, segmentation, stateful rules, workflow and sources on hand-made rows."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle import plugins as P
from corpuscle.operators import fusion as U
from corpuscle.operators import metrics as M
from corpuscle.operators import retrieval as R
from corpuscle.operators import segmentation as S
from corpuscle.operators import vectors as V
from corpuscle.plans import workflow as W
from corpuscle.sources import logs, snapshots
from corpuscle.streaming import stateful as X

HITS = [(1, "a", "d1", 0.9, 1), (1, "a", "d2", 0.5, 2), (1, "b", "d2", 0.8, 3), (1, "b", "d3", 0.4, 4)]


@pytest.fixture
def hits(spark):
    return spark.createDataFrame(HITS, "query_id long, node_id string, doc_id string, score double, seq long")


def scores(df):
    return {r.doc_id: r.score for r in df.collect()}


def test_fusion_by_hand(hits):
    assert scores(U.rrf(hits)) == pytest.approx({"d1": 1 / 61, "d2": 1 / 62 + 1 / 61, "d3": 1 / 62}, abs=1e-8)
    assert scores(U.relative_score(hits)) == {"d1": 1.0, "d2": 1.0, "d3": 0.0}
    assert scores(U.weighted_score(hits)) == pytest.approx({"d1": 0.45, "d2": 0.325, "d3": 0.2})
    assert scores(U.rrf_of_one_list(hits)) == pytest.approx({"d1": 1 / 61, "d2": 1 / 63, "d3": 1 / 64}, abs=1e-8)
    assert scores(U.rrf(hits, {"a": 0.4, "b": 0.6})) == pytest.approx({"d1": 0.4 / 61, "d2": 0.4 / 62 + 0.6 / 61, "d3": 0.6 / 62}, abs=1e-8)
    for policy, want in (("first", 0.5), ("highest", 0.8), ("latest", 0.8), ("average", 0.65)):
        assert scores(U.dedup(hits, ["query_id", "doc_id"], policy))["d2"] == pytest.approx(want)


def test_prune_looks_at_dropped_rows_too(spark):
    rows = [(i, [math.cos(math.radians(10 * i)), math.sin(math.radians(10 * i))]) for i in range(3)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r.vec_id for r in V.prune(e, "vec_id", "embedding", math.cos(math.radians(10)) - 1e-5).collect()] == [0]


def test_prune_queries_at_the_threshold_of_the_reference(spark, tmp_path):
    from corpuscle.plans import catalog

    rows = [(i, [math.cos(math.radians(a)), math.sin(math.radians(a))], 0) for i, a in enumerate((0, 5, 40))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    kept = {n: sorted(r.vec_id for r in catalog.queries()[n](spark, str(tmp_path)).collect()) for n in ("v13_prune_low", "v13_near_duplicate_prune")}
    assert kept == {"v13_prune_low": [0], "v13_near_duplicate_prune": [0, 2]}
    assert catalog.queries()["v14_index_optimise"](spark, str(tmp_path)).first().kept == 2


def test_passage_position_takes_the_first_hit_or_falls_back(spark):
    from corpuscle.plans.join_queries import position

    cases = [("a b c d e", "x A, b! c d z a b c d e y"), ("a b c d e", "e a x c x x x"), ("a b c", "b c a c"), ("a b c d e", "b e"), ("a b", "y z")]
    got = [tuple(r) for r in position(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, _q string, _d string")).orderBy("id").select("start", "share", "loose").collect()]
    assert got == [(1, 0.8, None), (1, 0.4, None), (1, 0.333333, None), (None, 0.0, 2), (None, 0.0, 0)]


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.95])
def test_similar_pairs_lose_none(spark, threshold):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 5))
    v[60:] = v[:60] + rng.normal(scale=0.1, size=(60, 5))
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for j in range(120) for i in range(j) if round(float(u[i] @ u[j]), 6) >= threshold}
    assert {(r.a, r.b) for r in V.similar_pairs(e, "vec_id", "embedding", threshold).collect()} == want


@pytest.mark.parametrize("kind", ["double", "float"])
def test_nearest_earlier_against_brute_force(spark, monkeypatch, kind):
    for name, value in (("STRIP", 40), ("BLOCK", 20), ("SCORES", 100)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 4)).astype(np.float32).astype(float)
    v[100:130] = v[7]  # copies
    v[150:] = v[50:100] * 2
    held = [(int(k), x.tolist()) for k, x in zip(rng.permutation(200), v, strict=True)]
    odd = [(900, [0.0] * 4), (901, [float("nan")] * 4), (902, None), (903, [1.0, None, 0.0, 0.0]), (None, [1.0] * 4), (904, [float("inf"), 1.0, 0.0, 0.0])]
    e = spark.createDataFrame(held + odd, f"vec_id long, embedding array<{kind}>")
    for threshold in (-1.0, 0.5, 0.999):
        want = {}
        for b, y in held:
            near = [(-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6), a) for a, x in held if a < b]
            if near and -min(near)[0] >= threshold:
                want[b] = (min(near)[1], -min(near)[0])
        got = V.nearest_earlier(e, "vec_id", "embedding", threshold).collect()
        assert {r.b: (r.a, r.cosine) for r in got} == want and len(got) == len(want)
    assert V.nearest_earlier(e.where("vec_id > 899"), "vec_id", "embedding", 0.5).count() == 0


def test_tops_hold_a_bounded_block_of_scores(monkeypatch):
    monkeypatch.setattr(V, "SCORES", 100, raising=False)
    q, rows = np.random.default_rng(4).normal(size=(2, 50, 3))
    parts = list(V._tops(q, rows, np.arange(50), 5))
    assert len(parts) == 25 and all(len(query) == 10 for query, _, _ in parts)
    best = [[i for _, i in sorted((-round(float(x @ y), 6), i) for i, y in enumerate(rows))[:5]] for x in q]
    assert np.concatenate([ids for _, ids, _ in parts]).reshape(50, 5).tolist() == best


@pytest.mark.parametrize("function", ["dense_topk", "cell_topk"])
def test_topk_against_brute_force(spark, function):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = getattr(V, function)(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 7).collect()
    s = np.round(v.astype(float) @ v.astype(float).T, 6)
    want = {(q, int(d), k + 1) for q in range(0, 300, 20) for k, d in enumerate(np.lexsort((np.arange(300), -s[q]))[:7])}
    assert {(r.query_id, r.doc_id, r.rank) for r in got} == want


def test_quantisation_round_trip(spark):
    e = spark.createDataFrame([(1, [0.0, 0.5, 1.0, 0.25]), (2, [3.0, 3.0, 3.0, 3.0])], "vec_id long, v array<double>")
    for r in e.select("v", V.dequantise(V.quantise(F.col("v"), 255)).alias("w")).collect():
        assert r.w == pytest.approx(r.v, abs=1 / 255)
    assert e.select(V.cosine(F.col("v"), F.array(*[F.lit(0.0)] * 4)).alias("c")).first().c == 0.0


def test_sentences_and_offsets(spark):
    text = "One two.  Three? four\n| a. b |\n\n  last"
    rows = S.sentences(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).orderBy("start").collect()
    assert [r.sentence for r in rows] == ["One two.", "Three?", "four", "| a. b |", "last"]
    assert all(text[r.start : r.end] == r.sentence for r in rows)


def test_folds():
    pieces = S.hard_split("A" * 2000, 500)
    assert len(pieces) == 4 and "".join(pieces) == "A" * 2000
    assert "".join(S.hard_split("word " * 700)) == "word " * 700 and max(map(len, S.hard_split("word " * 700))) <= 1500
    assert S.merge_short(["A long enough sentence to stand alone.", "Short.", "# Header", "tiny"]) == ["A long enough sentence to stand alone. Short.", "# Header", "tiny"]
    assert S.safety_breaks([500, 500, 500], []) == [1] and S.safety_breaks([500, 500, 500], [2]) == [2]
    assert [(c["start"], c["end"]) for c in S.merge_chunks([{"start": 0, "end": 50, "section": "a"}, {"start": 50, "end": 400, "section": "a"}, {"start": 400, "end": 500, "section": "b"}])] == [(0, 400), (400, 500)]
    split = S.recursive_split("para one. " * 30 + "\n\n" + "x" * 1200, 500, 100)
    assert max(map(len, split)) <= 500


def test_adjacent_merge(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 15, 25), ("a", 30, 40), ("b", 0, 5), ("b", 50, 60)], "source string, start long, end long")
    got = {(r.source, r.start, r.end) for r in S.merge_adjacent(rows, ["source"]).collect()}
    assert got == {("a", 0, 40), ("b", 0, 5), ("b", 50, 60)}


def test_percentile_rules(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (5, 1, 4, 2, 3)], "k long, v double")
    picks = {r: M.percentile_place(0.95, r) for r in ("n1", "clamped", "raw")}
    assert M.rank_pick(df, ["k"], "v", picks, []).first().asDict() == {"k": 1, "n1": 4.0, "clamped": 5.0, "raw": 5.0}


def test_half_trend_needs_time_order(spark):
    df = spark.createDataFrame([(1, t, float(10 - t)) for t in range(10)], "k long, t long, v double")
    assert M.half_trend(df, ["k"], "v", ["t"]).first().trend == "improving"
    assert M.half_trend(df, ["k"], "v", ["t"], faithful=True).first().trend == "degrading"


def test_alert_conditions(spark):
    ops = [(">", 1.0, False), ("==", 1.00005, True), ("!=", 1.00005, False), (">=", 1.0, True), ("?", 9.0, False)]
    df = spark.createDataFrame(ops, "op string, v double, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", M.condition(F.col("v"), F.col("op"), F.lit(1.0))).collect())


def test_token_buffer():
    b = X.TokenBuffer(size=3, timeout_ms=100)
    assert [b.step(t, i) for i, t in enumerate("abcd")] == ["a", None, None, "bcd"]
    assert b.step("e", 10) is None and b.step("f", 200) == "ef" and b.flush(201) is None


def test_adaptive_size():
    a = X.AdaptiveSize()
    assert [a.step(400.0) for _ in range(12)][-3:] == [3, 5, 7]
    for _ in range(60):
        a.step(10.0)
    assert a.size == 1


def test_adaptive_size_on_its_limits_and_with_missing_latencies():
    a = X.AdaptiveSize(size=5)
    on = [x * 10 for x in (29.27, 30.73, 29.33, 30.67, 29.29, 30.71, 29.59, 30.41, 28.91, 31.09)]  # 300 ms each two, but for the last bits
    for values in itertools.permutations(on[:5]):
        a.seen = [*values, *on[5:-1]]
        assert a.step(on[-1]) == 5
    b = X.AdaptiveSize()
    assert [b.step(x) for x in [None] * 8 + [400.0, float("nan"), 400.0]][-3:] == [1, 3, 5]
    assert [X.AdaptiveSize().step(None) for _ in range(12)][-1] == 1


def test_circuit_breaker():
    c = X.CircuitBreaker(failures=2, wait=10, successes=2)
    said = [c.step(*e) for e in ((False, 0), (False, 1), (True, 2), (True, 12), (True, 13), (False, 14), (False, 15), (False, 30))]
    assert said == ["closed", "open", "rejected", "half_open", "closed", "closed", "open", "open"]


def test_lru_ttl_cache():
    c = X.LruTtlCache(2, 10)
    assert [c.step(k, t) for k, t in (("a", 0), ("b", 1), ("a", 2), ("c", 3), ("b", 4), ("a", 20))] == ["miss", "miss", "hit", "miss", "miss", "miss"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{k}", i, f"t{i} ", i * 10.0) for k in range(3) for i in range(25)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, token string, ms double")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = X.stream_tokens(stream, size=4, timeout_ms=60_000, idle_flush=False).writeStream.format("memory").queryName("chunks").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    got = sorted((r.stream_id, r.chunk) for r in spark.sql("select * from chunks").collect())
    batch = X.replay(df, "stream_id", ["seq"], ["token", "ms"], lambda: X.TokenBuffer(4, 60_000), "chunk").where("chunk is not null")
    assert got == sorted((r.stream_id, r.chunk) for r in batch.collect())


def test_bm25_finds_the_document(spark):
    docs = spark.createDataFrame([(i, f"common words here {'needle' if i == 3 else 'hay'} {i}") for i in range(9)] + [(9, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "needle words"), (2, "")], "query_id long, text string")
    got = R.bm25_topk(docs, queries, 3).collect()
    assert {r.query_id for r in got} == {1} and min(got, key=lambda r: r.rank).doc_id == 3


def test_workflow_routes(spark):
    docs = spark.createDataFrame([(i, f"The engine number {i} turns slowly. It rests at night.") for i in range(6)] + [(9, "Completely different matters of gardening.")], "doc_id long, text string")
    asked = [(1, "hi there"), (2, "engine turns slowly"), (3, "gardening qqqq wwww eeee rrrr tttt yyyy uuuu iiii oooo"), (4, "cached one")]
    got = {r.query_id: r for r in W.answer(docs, spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame([(4, "known")], "query_id long, answer string")).collect()}
    assert got[1].route == "general" and got[2].retries == 0 and got[2].answer.startswith("The engine")
    assert (got[3].retries, got[4].route, got[4].answer) == (1, "cached", "known")


def test_plugins(spark):
    df = spark.createDataFrame([("a",), ("bb",)], "t string")

    def broken(texts):
        raise RuntimeError("no model")

    steps = P.first_answer(P.batched(broken, "t", "n", "bigint"), P.batched(lambda x: [len(s) for s in x], "t", "n", "bigint"), out="n")
    assert [r.n for r in P.stack(steps)(df).orderBy("t").collect()] == [1, 2]


def test_snapshots_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    path = str(tmp_path / "snap")
    assert snapshots.load(spark, path, ["id"]) is None
    snapshots.save(df, path, ["id"])
    assert snapshots.load(spark, path, ["id"]).count() == 2
    spark.createDataFrame([(3, "c")], df.schema).write.mode("append").parquet(f"{path}/rows")
    assert snapshots.load(spark, path, ["id"]) is None
    lines = spark.createDataFrame([("took 12 ms",), ("noise",)], "value string")
    assert [r.ms for r in logs.scan(lines, r"took ([0-9]+) ms", ["ms"]).collect()] == ["12"]
    snapshots.write_metrics_csv(df, f"{tmp_path}/csv")
    snapshots.append_history(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_diversity_and_limit(spark):
    hits = spark.createDataFrame([(1, i, 1.0 - i / 10, i + 1, ["a", "b"] if i < 2 else [f"x{i}"]) for i in range(12)], "query_id long, doc_id long, score double, rank int, terms array<string>")
    out = {r.doc_id: r.score for r in R.diversity(hits, "terms").collect()}
    assert out[0] == pytest.approx(1.0) and out[1] == pytest.approx(0.7 * 0.9 + 0.3 * 0.9)
    steep = hits.withColumn("score", F.when(F.col("rank") == 1, 1.0).otherwise(0.1))
    assert R.dynamic_limit(steep, ["query_id"]).count() == 10 and R.dynamic_limit(hits, ["query_id"]).count() == 12


def test_rounding_keeps_the_sign_of_zero(spark):
    """As floating-point rounding, and so the SQL twins, have it."""
    values = [-1e-9, 1e-9, -0.0, 0.0, -1.2345675, 2.5, None]
    got = [r[0][0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(F.transform(F.array("x"), V.rounded)).collect()]
    assert [str(x) for x in got] == ["-0.0", "0.0", "-0.0", "0.0", "-1.234568", "2.5", "None"]


def test_queries_hand_python_small_batches(spark):
    from corpuscle.plans.registry import REGISTRY

    held = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        REGISTRY.queries["v3_embed_documents"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000" and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_cells_are_scanned_as_matrices(spark, most_bytes):
    """The k best are those of the whole scan, for queries that are broadcast and for those that are not."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 8).tolist() if i % 11 else [1.0] * 8) for i in range(600)]
    e = spark.createDataFrame([*rows, (600, None)], "vec_id bigint, v array<double>")
    asked = e.where("vec_id % 20 = 0")
    found = V.cell_topk(e, asked, "vec_id", "v", 7, most_bytes=most_bytes)
    assert "first" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = V.dense_topk(e, asked, "vec_id", "v", 7)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("kind", ["double", "float"])
def test_tiles_give_pairs_and_counts_at_low_thresholds(spark, monkeypatch, kind):
    """Every pair at and beside the threshold, in several strips, without rows that visit cells; counts without a list of pairs."""
    for name, value in (("STRIP", 40), ("BLOCK", 20), ("SCORES", 100), ("PAIRS", 7)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(160, 4)).astype(np.float32).astype(float)
    v[100:120] = v[7]
    v[120:140] = [[3e-7 * (i - 10), 1.0, 0.0, 0.0] for i in range(20)]
    v[140] = [1.0, 0.0, 0.0, 0.0]
    held = [(int(k), x.tolist()) for k, x in zip(rng.permutation(160), v, strict=True)]
    odd = [(900, [0.0] * 4), (901, [float("nan")] * 4), (902, None), (None, [1.0] * 4)]
    e = spark.createDataFrame(held + odd, f"vec_id long, embedding array<{kind}>")
    u = {k: np.array(x, np.float32 if kind == "float" else float).astype(float) for k, x in held}
    u = {k: x / np.linalg.norm(x) for k, x in u.items()}
    for threshold in (-1.0, 0.0, 0.3, 0.5):
        want = {(a, b): round(float(x @ y), 6) for b, y in u.items() for a, x in u.items() if a < b and round(float(x @ y), 6) >= threshold}
        pairs = V.similar_pairs(e, "vec_id", "embedding", threshold)
        assert "visits" not in pairs._jdf.queryExecution().analyzed().toString()
        got = pairs.collect()
        assert {(r.a, r.b): r.cosine for r in got} == want and len(got) == len(want)
        counts = V.earlier_counts(e, "vec_id", "embedding", threshold).collect()
        assert {r.b: r.earlier for r in counts} == Counter(b for _, b in want) and len(counts) == len({b for _, b in want})
    assert V.similar_pairs(e.where("vec_id > 899"), "vec_id", "embedding", 0.3).count() == 0


def test_an_ampersand_without_its_semicolon_is_text():
    from corpuscle.sources.pages import html_pages

    assert html_pages(b"<h1>a &amp; b&amp</h1><p>c &lt; d &am")[0].titles == ["a & b&amp"]
