"""Service extension points, file sources and sinks, routing rules, ranks by ranges and page overlaps on hand-made rows."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle import services
from corpuscle.operators import metrics, routing, segmentation, vectors
from corpuscle.plans import serving_queries
from corpuscle.sources import services as files
from corpuscle.streaming import stateful


def test_event_handlers_swallow_failures(spark):
    seen, handlers = [], services.EventHandlers()
    bad = lambda events: 1 / 0
    handlers.register(bad)
    handlers.register(lambda events: seen.append(events.count()))
    handlers.emit(spark.range(3))
    handlers.unregister(bad)
    handlers.emit(spark.range(2))
    assert seen == [3, 2] and handlers.failures == 1


def test_table_cache(spark, tmp_path):
    cache = services.TableCache(spark, str(tmp_path / "cache"))
    rows = lambda *kv: spark.createDataFrame(list(kv), "key string, value string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    cache.put(rows(("a", "1"), ("b", "2")), now=10, ttl=5)
    cache.put(rows(("a", "3")), now=11)
    assert {r.key: r.value for r in cache.get(keys, now=12).collect()} == {"a": "3", "b": "2", "c": None}
    assert {r.key: r.value for r in cache.get(keys, now=16).collect()} == {"a": "3", "b": None, "c": None}
    cache.delete(keys.where("key = 'a'"))
    assert cache.stats(now=12) == {"entries": 1, "bytes": 1}
    cache.clear()
    assert cache.stats(now=12) == {"entries": 0, "bytes": 0}


def test_retry_and_recovery():
    waits, calls = [], []
    policy = services.RetryPolicy(attempts=3, wait=1, factor=3, longest=2, on=(KeyError,), sleep=waits.append)

    def fails(error):
        calls.append(error)
        raise error("no")

    with pytest.raises(KeyError):
        policy.call(fails, KeyError)
    assert waits == [1, 2] and len(calls) == 3
    with pytest.raises(ValueError):
        policy.call(fails, ValueError)
    assert len(calls) == 4 and policy.call(lambda: 5) == 5
    chain = services.RecoveryChain([lambda e: 1 / 0, lambda e: f"after {type(e).__name__}"])
    assert chain.call(lambda: {}["x"]) == "after KeyError" and len(chain.errors()) == 2


def test_tracking_and_observation(spark):
    told = []
    add = services.tracked("add", lambda *x: told.append(x))(lambda a, b: a / b)
    assert add(4, 2) == 2
    with pytest.raises(ZeroDivisionError):
        add(1, 0)
    assert [(n, good) for n, _, good in told] == [("add", True), ("add", False)]
    rows, seen = services.observed(spark.range(5), "five", "id")
    rows.collect()
    assert seen.get == {"rows": 5, "sum_id": 10}


def test_notification_channels_limit_and_count(spark):
    class Box(services.NotificationChannel):
        def send(self, message):
            if message["message"] == "bad":
                raise OSError
            return True

    alerts = spark.createDataFrame([(1, 0.0, "low"), (3, 1.0, "x"), (3, 2.0, "bad"), (3, 3.0, "y"), (3, 4.0, "z"), (3, 100.0, "later")], "severity int, at double, message string")
    assert services.notify(alerts, [Box("box", least=2, most=2)]) == {"box": {"sent": 3, "failed": 1, "held": 1}}


def test_settings_from_file_and_environment(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"k": 5, "extra": "kept"}))
    got = files.settings(str(tmp_path / "c.json"), {"k": 1, "rate": 0.5, "on": False, "name": "a"}, {"CORPUSCLE_RATE": "0.25", "CORPUSCLE_ON": "yes", "CORPUSCLE_K": "no number"})
    assert got == {"k": 5, "rate": 0.25, "on": True, "name": "a", "extra": "kept"}


def test_files_land_under_their_names_in_few_folders(spark, tmp_path):
    held = {f"page-{i}.{'TXT' if i % 3 else 'bin'}": f"text {i}\n\x00".encode() * (i % 4) for i in range(200)}
    rows = spark.createDataFrame([(n, bytearray(c) or None) for n, c in held.items()], "name string, content binary").repartition(3)
    assert files.land(rows, f"file:{tmp_path}/in", buckets=5) == 200 and files.land(rows.limit(7), str(tmp_path / "in"), buckets=5) == 7  # again: nothing new
    assert len(list((tmp_path / "in").iterdir())) == 5
    got = files.uploads(spark, str(tmp_path / "in/*"), ".txt").collect()
    assert {r.path.rsplit("/", 1)[-1]: bytes(r.content) for r in got} == {n: c for n, c in held.items() if n.endswith("TXT") and c}  # Spark skips empty files
    html = ["", "a\x00", "b\n", "é"] * 2
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = serving_queries.REGISTRY.queries["s11_upload_contents"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((f"page-{i}.txt", hashlib.sha256(t.encode()).hexdigest(), len(t.encode())) for i, t in enumerate(html) if i % 5)


def test_streamed_log_and_uploads(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("list", "a,1"), ("dict", '{"b":2}'), ("other", "x")], "kind string, payload string").write.json(str(source))
    stream = spark.readStream.schema("kind string, payload string").json(str(source))
    query = files.stream_log(stream, str(tmp_path / "log"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert [r.payload for r in files.read_log(spark, str(tmp_path / "log"), "csv").collect()] == ["a,1"]
    assert [r.payload for r in files.read_log(spark, str(tmp_path / "log"), "jsonl").collect()] == ['{"b":2}']
    (tmp_path / "a.PDF").write_bytes(b"one")
    (tmp_path / "b.exe").write_bytes(b"two")
    assert [r.content for r in files.uploads(spark, str(tmp_path / "*.*")).collect()] == [b"one"]


def test_routing_rules(spark):
    rows = spark.createDataFrame([("안녕",), ("Hi",), ("hello there friend",), ("v1.2",), ("차이",), ("차이 abc12",), ("plain words",)], "q string")
    got = {r.q: (r.i, r.w) for r in rows.select("q", routing.intent(F.col("q")).alias("i"), routing.sparse_weight(F.col("q")).alias("w")).collect()}
    assert got == {"안녕": ("general", 0.4), "Hi": ("general", 0.4), "hello there friend": ("rag", 0.4), "v1.2": ("rag", 0.8), "차이": ("rag", 0.2), "차이 abc12": ("rag", 0.4), "plain words": ("rag", 0.4)}
    assert rows.select(routing.intent(F.col("q"), ["plain"], 20).alias("i")).where("i = 'general'").count() == 1


def test_ranks_by_ranges(spark):
    rng = random.Random(1)
    rows = [(k, float(rng.choice([1, 2, 2, 5, rng.random()])), i) for i, k in enumerate(["a"] * 500 + ["b"] * 3 + [None] * 40)] + [("b", None, 900)]
    got = metrics.numbered(spark.createDataFrame(rows, "k string, v double, i long"), ["k"], ["v", "i"], ranges=8).collect()
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert {r.i: r["_at"] for r in got if r.k == key} == {r[2]: at for at, r in enumerate(own)} and {r.n for r in got if r.k == key} == {len(own)}
    middle = {r.k: r.median for r in metrics.medians(spark.createDataFrame(rows, "k string, v double, i long"), ["k"], "v").collect()}
    for key in ("a", "b", None):
        assert middle[key] == pytest.approx(np.median([r[1] for r in rows if r[0] == key and r[1] is not None]))


@pytest.mark.parametrize("threshold", [0.3, 0.9, 0.98])
def test_similar_pairs_over_cells_match_brute_force(spark, threshold):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 12))
    v = np.concatenate([base, base + rng.normal(size=base.shape) * 0.15, base[:9] * 2, np.zeros((1, 12))])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "i long, v array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    c = np.round(unit @ unit.T, 6)
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if c[i, j] >= threshold}
    got = [(r.a, r.b) for r in vectors.similar_pairs(df, "i", "v", threshold, cells=7).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_dense_topk_by_broadcast_and_by_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, size=(300, 6)).astype(float)  # many ties
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "i long, v array<double>").repartition(5)
    asked = df.where("i % 20 = 0")
    want = {i: sorted(range(300), key=lambda j: (-(v[i] @ v[j]), j))[:7] for i in range(0, 300, 20)}
    for most in (1 << 20, 0):
        got = vectors.dense_topk(df, asked, "i", "v", 7, most).collect()
        assert {i: [r.doc_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] for i in want} == want


def test_pages_of_chunks(spark):
    chunks = spark.createDataFrame([("d", 0, 0, 10), ("d", 1, 10, 25), ("d", 2, 90, 9000), ("e", 0, 0, 5), ("d", 3, 9500, 9600)], "k string, c long, start long, end long")
    pages = spark.createDataFrame([("d", p, p * 100, p * 100 + 99) for p in range(95)] + [("e", 7, 0, 3)], "k string, page long, start long, end long")
    got = {(r.k, r.c): (r.page, r.pages, r.is_cross_page) for r in segmentation.pages_of(chunks, pages, "k", "c", window=128).collect()}
    assert got == {("d", 0): (0, [0], False), ("d", 1): (0, [0], False), ("d", 2): (0, list(range(90)), True), ("e", 0): (7, [7], False)}


def test_token_buffer_gives_all_tokens(spark):
    rows = [("s", i, f"t{i} ", 20.0 * i) for i in range(23)] + [("r", 0, "only", 0.0)]
    got = stateful.replay(spark.createDataFrame(rows, "k string, seq long, token string, ms double"), "k", ["seq"], ["token", "ms"], stateful.TokenBuffer, "chunk").where("chunk is not null").collect()
    assert "".join(r.chunk for r in sorted((r for r in got if r.k == "s"), key=lambda r: r.seq)) == "".join(f"t{i} " for i in range(23))


def test_bounded_response_drops_to_80_percent(spark):
    rng = random.Random(5)
    rows = [("a", i, "x" * rng.randint(0, 40)) for i in range(60)] + [("b", 0, "y" * 300), ("b", 1, "z")]
    want = {}
    for key in ("a", "b"):
        held: list[int] = []
        for _, _, text in (r for r in rows if r[0] == key):
            if sum(held) + len(text) > 100:
                while held and sum(held) > 80:
                    held.pop(0)
            held.append(len(text))
        want[key] = (len(held), sum(held))
    got = stateful.bounded_response(spark.createDataFrame(rows, "k string, i long, t string"), "k", "i", "t", 100)
    assert {r.k: (r.chunks, r.chars) for r in got.collect()} == want
