"""Stored indexes, read-through, similarity as of a time, range digests, typed streams and pages."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import bm25_index, digests, fusion, retrieval, vectors
from corpuscle.operators.asof import asof_similar
from corpuscle.operators.bm25_index import Bm25Index
from corpuscle.operators.metadata_index import MetadataIndex
from corpuscle.operators.readthrough import ReadThrough
from corpuscle.operators.vector_index import CellIndex
from corpuscle.sources import pages, snapshots
from corpuscle.sources.stores import Store
from corpuscle.services import TableCache
from corpuscle.streaming import typed


def docs_of(spark, n, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(rng.randrange(1, 9)))) for i in range(n)], "doc_id bigint, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


# stores


def test_store_reads_what_was_committed_and_purges_the_rest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1,)], "x int")
    assert store.live() == [] and not store.known("a") and store.part("p", "x int").count() == 0 and store.purge() == 0
    for entry in ("a", "b"):
        folder = store.folder()
        store.write(one, folder, "p")
        store.commit(entry, "add", folder)
    store.write(one, store.folder(), "p")  # never committed
    assert store.part("p", "x int").count() == 2 and store.known("b")
    folder = store.folder()
    store.write(one, folder, "p")
    store.commit("c", "compact", folder, ["a", "b"])
    assert [r["entry"] for r in store.live()] == ["c"] and store.known("a") and store.part("p", "x int").count() == 1
    assert store.purge() == 3 and store.part("p", "x int").count() == 1


def test_an_empty_store_is_read_without_python(spark, tmp_path):
    empty = Store(spark, str(tmp_path / "s")).part("p", "hash string, vector array<double>")
    assert empty.dtypes == [("hash", "string"), ("vector", "array<double>")] and empty.count() == 0
    assert "RDD" not in empty._jdf.queryExecution().executedPlan().toString()


def test_snapshot_is_rewritten_after_a_crash_and_purged_when_spoilt(spark, tmp_path):
    path, df = str(tmp_path / "snap"), spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    df.limit(1).write.parquet(f"{path}/rows")  # a save that ended before its manifest
    assert snapshots.load(spark, path, ["id"]) is None
    snapshots.save(df, path, ["id"])
    snapshots.save(df.limit(0), path, ["id"])  # one that is there stays
    assert rows(snapshots.load(spark, path, ["id"])) == [(1, "a"), (2, "b")]
    df.write.mode("append").parquet(f"{path}/manifest")
    assert snapshots.load(spark, path, ["id"]) is None and not snapshots.saved(spark, path)


def test_table_cache_goes_on_where_it_was_and_compacts(spark, tmp_path):
    put = lambda cache, k, v: cache.put(spark.createDataFrame([(k, v)], "key string, value string"), now=1)
    cache = TableCache(spark, str(tmp_path / "c"))
    put(cache, "a", "1")
    put(cache, "a", "2")
    again = TableCache(spark, str(tmp_path / "c"))
    assert again.stats(now=2) == {"entries": 1, "bytes": 1}
    put(again, "a", "33")
    keys = spark.createDataFrame([("a",)], "key string")
    assert [r.value for r in cache.get(keys, now=2).collect()] == ["33"]
    again.compact(now=2)
    put(again, "b", "4")
    assert len(again.store.live()) == 2 and again.stats(now=2) == {"entries": 2, "bytes": 3}


# BM25


def test_bm25_index_plus_a_batch_equals_one_built_anew(spark, tmp_path):
    docs = docs_of(spark, 60)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "kappa"), (3, "nothing")], "query_id bigint, text string")
    index = Bm25Index(spark, str(tmp_path / "i"))
    assert index.add(docs.where("doc_id < 40"), "one", dedup=False) == {"indexed": 40, "duplicates": 0, "known": 0}
    before = rows(index.search(asked, 10))
    assert before == rows(retrieval.bm25_topk(docs.where("doc_id < 40"), asked, 10))
    index.add(docs.where("doc_id >= 35"), "two", dedup=False)  # five are there
    want = rows(retrieval.bm25_topk(docs, asked, 10))
    assert rows(index.search(asked, 10)) == want != before
    assert index.add(docs, "two")["known"] == 1 and rows(index.search(asked, 10)) == want  # a repeated batch changes nothing
    index.compact()
    assert len(index.store.live()) == 1 and rows(index.search(asked, 10)) == want
    assert index.add(docs, "one")["known"] == 1 and index.store.purge() == 2 and rows(index.search(asked, 10)) == want
    plan = index.search(asked, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan


def test_bm25_batches_leave_out_copies_and_survive_a_crash(spark, tmp_path, monkeypatch):
    index = Bm25Index(spark, str(tmp_path / "i"))
    docs = spark.createDataFrame([(1, "alpha"), (2, "alpha"), (3, None), (4, "")], "doc_id bigint, text string")
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.add(docs, "one")
    assert index.documents().count() == 0
    assert index.add(docs, "one") == {"indexed": 2, "duplicates": 2, "known": 0}
    assert index.add(docs.withColumn("doc_id", F.col("doc_id") + 10), "two") == {"indexed": 0, "duplicates": 4, "known": 0}
    assert index.store.purge() == 1


def test_bm25_lists_are_rows_of_many_documents_and_a_text_is_searched_once(spark, tmp_path):
    index = Bm25Index(spark, str(tmp_path / "i"))
    for batch in (0, 1):
        index.add(docs_of(spark, 120).where(f"doc_id % 2 = {batch}").coalesce(1), f"batch-{batch}", dedup=False)
    index.compact()
    held = spark.read.parquet(f"{tmp_path}/i/{index.store.live()[0]['folder']}/postings").where("term is not null")
    met = index.idf().agg(F.sum("df")).first()[0]
    assert met > 300 and held.count() <= 2 * 4 * 10 and index.documents().where("hash is null or dl < 1").count() == 0  # batches, tasks, terms
    plan = docs_of(spark, 1).select(index.tokens(F.col("text")).alias("terms"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_bm25_turns_documents_to_terms_some_at_a_time(monkeypatch):
    monkeypatch.setattr(bm25_index, "HELD", 4)
    monkeypatch.setattr(bm25_index, "ROWS", 2)
    docs = [(1, "x", ["a", "b"]), (2, "y", []), (3, "z", None), (4, "u", ["b", None, "c"]), (5, "v", ["a"])]
    batches = [pa.RecordBatch.from_arrays([pa.array([d[0]], pa.int64()), pa.array([d[1]]), pa.array([d[2]], pa.list_(pa.string()))], names=["doc_id", "hash", "terms"]) for d in docs]
    got = [b.to_pylist() for b in bm25_index._inverted(iter(batches))]
    lists = [(r["term"], d, n) for b in got for r in b if r["term"] is not None for d, n in zip(r["doc_ids"], r["dls"])]
    assert sorted(lists) == [("a", 1, 2), ("a", 5, 1), ("b", 1, 2), ("b", 4, 3), ("c", 4, 3)] and max(map(len, got)) == 2
    assert [(r["doc_ids"], r["dls"], r["hashes"]) for b in got for r in b if r["term"] is None] == [([1, 2, 3, 4], [2, 0, 0, 3], ["x", "y", "z", "u"]), ([5], [1], ["v"])]


def test_bm25_index_takes_another_tokenizer(spark, tmp_path):
    halves = lambda text: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ -]"), lambda w: w != ""))
    index = Bm25Index(spark, str(tmp_path / "i"), halves)
    index.add(spark.createDataFrame([(1, "re-use it"), (2, "use"), (3, None)], "doc_id bigint, text string"), "one", dedup=False)
    asked = spark.createDataFrame([(1, "RE-run")], "query_id bigint, text string")
    assert [r.doc_id for r in index.search(asked, 5).collect()] == [1] and index.documents().count() == 3


# vectors


def test_cell_index_is_shared_pruned_and_recalls(spark, tmp_path):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((12, 16))
    v = centers[rng.integers(0, 12, 900)] + 0.3 * rng.standard_normal((900, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(901, None)], "id long, v array<double>")
    index = CellIndex(spark, str(tmp_path / "i"))
    index.build(df.where("id % 3 <> 0 or id is null"), "id", "v", cells=12)
    index.build(df, "id", "v", cells=3)  # is there
    index.add(df.where("id % 3 = 0"), "id", "v", "later")
    index.add(df, "id", "v", "later")  # a repeated batch
    assert index.rows().count() == 900 and len(index.centres()) == 12
    hits = 0
    for rest in (0, 7):
        asked = df.where(f"id % 20 = {rest}")
        found = index.search(asked, "id", "v", 10, probes=3)
        true = {(r.query_id, r.doc_id) for r in vectors.dense_topk(df, asked, "id", "v", 10).collect()}
        hits += len(true & {(r.query_id, r.doc_id) for r in found.collect()}) / len(true) / 2
    assert hits >= 0.9
    one = df.where("id = 20")
    plan = index.search(one, "id", "v", 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and len(index.probed(one, "id", "v", 2)[1]) == 2
    exact = {r.doc_id: r.score for r in index.search(one, "id", "v", 5, probes=2).collect()}
    assert all(abs(s - float(v[20] @ v[d])) < 1e-6 for d, s in exact.items())


def test_dense_topk_in_blocks_breaks_ties_by_id(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (200, 4)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    want = {(q, d, r + 1) for q in range(0, 200, 5) for r, d in enumerate(sorted(range(200), key=lambda d: (-float(v[q] @ v[d]), d))[:6])}
    for cells, most in ((1 << 22, 1 << 20), (150, 1 << 20), (150, 0)):
        monkeypatch.setattr(vectors, "CELLS", cells)
        got = vectors.dense_topk(df, df.where("id % 5 = 0"), "id", "v", 6, most)
        assert {(r.query_id, r.doc_id, r["rank"]) for r in got.collect()} == want


# metadata


def test_metadata_index_intersects_and_prunes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ["x", "y"], 1), (2, "a", ["x"], 2), (3, "b", ["x", "y"], 1), (4, None, None, 1)], "id long, source string, tags array<string>, page int")
    index = MetadataIndex(spark, str(tmp_path / "m"))
    index.build(df.where("id < 3"), "id", ["source", "tags", "page"])
    index.build(df, "id", ["source", "tags", "page"])  # is there
    index.build(df.where("id >= 3"), "id", ["source", "tags", "page"], "second")
    find = lambda **w: sorted(r.id for r in index.search(w).collect())
    assert find(source="a") == [1, 2] and find(page=1) == [1, 3, 4] and find(source="a", page=1) == [1] and find(tags='["x","y"]', page="1") == [1, 3]
    assert find(source="zz") == [] and find(other="a") == [] and find(source="a", other="b") == []
    with pytest.raises(ValueError):
        index.search({})
    assert {r.field: (r.n_values, r.n_entries) for r in index.stats().collect()} == {"source": (2, 3), "tags": (2, 3), "page": (2, 4)}
    plan = index.search({"source": "a"})._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*field#[0-9]+ = source", plan)


# read-through


def test_read_through_embeds_each_text_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def embed(df, text, out):
        def count(batches):
            for b in batches:
                seen.add(len(b))
                yield b.assign(**{out: [[float(len(t))] for t in b[text]]})

        return df.mapInPandas(count, f"_hash string, {text} string, {out} array<double>")

    through = ReadThrough(Store(spark, str(tmp_path / "v")), embed)
    df = spark.createDataFrame([(i, "abc" if i % 3 else "x" * (i % 5)) for i in range(30)] + [(30, None)], "id int, text string")
    first = through(df.where("id < 9"), "text", "v").collect()
    assert len(first) == 9 and not any(r.v_cached for r in first) and seen.value == len({r.text for r in first})
    got = {r.id: (r.v, r.v_cached) for r in through(df, "text", "v").collect()}
    texts = {r.text or "" for r in df.collect()}
    assert len(got) == 31 and seen.value == len(texts) and all(got[r.id][0] == [float(len(r.text or ""))] for r in df.collect())
    assert {i for i, (_, c) in got.items() if not c} == {r.id for r in df.collect() if (r.text or "") not in {f.text for f in first}}
    through.compact()
    assert all(r.v_cached for r in through(df, "text", "v").collect()) and seen.value == len(texts)


# as of a time


@pytest.mark.parametrize(("capacity", "ttl", "size"), [(5, None, 8), (40, 30.0, 64), (3, 12.5, 4), (1000, None, 16)])
def test_asof_similarity_matches_brute_force(spark, capacity, ttl, size):
    rng = np.random.default_rng(capacity)
    base = rng.standard_normal((6, 3))
    entries = [(i, float(rng.integers(0, 60)), base[rng.integers(0, 6)] * rng.uniform(0.5, 2)) for i in range(90)]
    asked = [(i, float(rng.integers(0, 70)), base[rng.integers(0, 6)] + 0.05 * rng.standard_normal(3)) for i in range(70)]
    entries += [(900, 3.0, np.zeros(3))]
    frame = lambda r: spark.createDataFrame([(i, t, v.tolist()) for i, t, v in r], "id long, at double, vector array<double>")
    want = {}
    ordered = sorted((e for e in entries if e[0] != 900), key=lambda e: (e[1], e[0]))
    for i, t, v in asked:
        fit = [(round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), place, j) for place, (j, u, w) in enumerate(ordered) if u < t]
        live = [f for f in fit[-capacity:] if ttl is None or ordered[f[1]][1] > t - ttl]
        best = max((f for f in live if f[0] >= 0.95), default=None)
        if best:
            want[i] = (best[2], best[0])
    got = {r.id: (r.entry_id, r.cosine) for r in asof_similar(frame(entries), frame(asked), 0.95, capacity, ttl, size).collect()}
    assert got == want and want


def test_semantic_cache_drops_the_oldest_entry(spark):
    entry = lambda i, t, v: (i, float(t), [float(x) for x in v])
    frame = lambda r: spark.createDataFrame(r, "id long, at double, vector array<double>")
    entries = frame([entry(1, 1, [1.0, 0]), entry(2, 2, [0.0, 1]), entry(3, 3, [-1.0, 0])])
    asked = frame([entry(1, 2.5, [1.0, 0.0]), entry(2, 3.5, [1.0, 0.0]), entry(3, 3.5, [0.0, 2.0]), entry(4, 2, [0.0, 1.0])])
    assert rows(asof_similar(entries, asked, capacity=2)) == [(1, 1, 1.0), (3, 2, 1.0)]


# digests


def test_trees_tell_which_ranges_differ(spark):
    df = spark.createDataFrame([(i % 2, i, i * i) for i in range(5000)] + [(1, None, 5)], "site int, id long, v long")
    other = df.where("id is null or id <> 777").withColumn("v", F.when(F.col("id") == 4001, F.lit(0)).otherwise(F.col("v")))
    a, b = (digests.tree(t, ["site"], "id", ["v"], leaf=100, fan=4) for t in (df, other))
    assert rows(digests.differing(a, b, ["site"])) == [(1, 7, 50, 49), (1, 40, 50, 50)] and digests.differing(a, a, ["site"]).count() == 0
    assert rows(digests.consistent(a, b, ["site"])) == [(0, True), (1, False)]
    top = {r.level: r.c for r in a.where("site = 0 and node is not null").groupBy("level").count().withColumnRenamed("count", "c").collect()}
    assert top[max(top)] >= 1 and a.where("level = 0").agg(F.sum("n")).first()[0] == 5001


# fusion


def test_content_dedup_merges_through_ids_seen_before(spark):
    hits = [(1, "a", 10, 0.9, 1, "x"), (1, "b", 11, 0.8, 2, "x"), (1, "c", 10, 0.7, 3, "y"), (1, "d", 12, 0.6, 4, "y"), (1, "e", 13, 0.5, 5, None), (2, "a", 10, 0.4, 6, "x")]
    df = spark.createDataFrame(hits, "query_id int, node_id string, doc_id long, score double, seq long, content string")
    got = {(r.query_id, r.doc_id): (r.score, r.nodes, r.occurrences) for r in fusion.dedup_content(df, "content").collect()}
    assert got == {(1, 10): (0.9, "a,b,c,d", 4), (1, 13): (0.5, "e", 1), (2, 10): (0.4, "a", 1)}


# typed streams


def events_of(spark):
    e = lambda seq, mode, **k: ("s1" if seq % 2 else "s2", seq, float(seq), mode, *(k.get(c) for c in ("status", "documents", "thought", "content", "performance")))
    held = [e(1, "custom", status="go", documents="d", thought="t", content="ready"), e(3, "messages", content="a"), e(5, "messages", content="b"), e(7, "messages", thought="hm", content="c"), e(9, "messages", content="d"), e(11, "updates", documents="d2", performance="{}"), e(2, "messages", content="only"), e(4, "other", content="x"), e(6, "messages", content="")]
    return spark.createDataFrame(held, "session string, seq long, at_ms double, mode string, status string, documents string, thought string, content string, performance string")


WANT = {
    "s1": [("status", "go"), ("documents", "d"), ("thought", "t"), ("content", "ready"), ("content", "a"), ("thought", "hm"), ("content", "bc"), ("documents", "d2"), ("performance", "{}"), ("final", "d")],
    "s2": [("content", "only")],
}


def test_typed_events_become_numbered_chunks(spark):
    got = {}
    for r in typed.replay(events_of(spark), 2, 1e9).orderBy("session", "chunk_index").collect():
        got.setdefault(r.session, []).append((r.kind, r.content))
        assert r.chunk_index == len(got[r.session]) - 1
    assert got == WANT
    t = {r.session: (r.ttft, r.thinking, r.answer, r.total) for r in typed.timing(events_of(spark)).collect()}
    assert t["s1"] == (2.0, 2.0, 8.0, 10.0)


def test_typed_stream_keeps_its_state_between_batches(spark, tmp_path):
    events = events_of(spark)
    source, kept = str(tmp_path / "in"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for at, part in enumerate((events.where("seq <= 5"), events.where("seq > 5"))):
            part.coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(events.schema).parquet(source)
            query = typed.stream_chunks(stream, 2, 1e9, idle_ms=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None and at < 2
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("session", "chunk_index").collect():
        got.setdefault(r.session, []).append((r.kind, r.content))
    assert got == {k: [c for c in v if c[0] != "final"] for k, v in WANT.items()}


def test_a_silent_session_is_finished_once():
    class State:
        held = None
        get = lambda self: self.held
        update = lambda self, v: setattr(self, "held", v)
        clear = lambda self: setattr(self, "held", None)

    class Handle:
        timers: list[int] = []
        getValueState = lambda self, name, schema: State()
        listTimers = lambda self: iter(list(self.timers))
        deleteTimer = lambda self, t: self.timers.remove(t)
        registerTimer = lambda self, t: self.timers.append(t)

    class Now:
        getCurrentProcessingTimeInMs = lambda self: 1000

    import pandas as pd

    sessions = typed.Sessions(5, 1e9, 50)
    sessions.init(Handle())
    event = lambda seq: {"seq": seq, "mode": "messages", "status": None, "documents": None, "thought": None, "content": f"t{seq} ", "performance": None, "at_ms": float(seq)}
    first = list(sessions.handleInputRows(("s",), iter([pd.DataFrame([event(1), event(2)])]), Now()))[0]
    more = list(sessions.handleInputRows(("s",), iter([pd.DataFrame([event(3)])]), Now()))[0]
    assert list(first.content) == ["t1 "] and len(more) == 0 and sessions.handle.timers == [1050]
    last = list(sessions.handleExpiredTimer(("s",), Now(), None))
    assert [(r.chunk_index, r.kind, r.content, r.tokens) for r in last[0].itertuples()] == [(1, "final", "t2 t3 ", 2)]
    assert list(sessions.handleExpiredTimer(("s",), Now(), None)) == []


# pages


def test_pages_carry_sections_inside_a_file_only(spark, tmp_path):
    html = lambda title, *texts: "<html><body>" + (f"<h1>{title}</h1>" if title else "") + "".join(f"<p>{t}</p>" for t in texts) + "<script>no</script><table><tr><td>c</td></tr></table></body></html>"
    (tmp_path / "a.html").write_text("\f".join([html("", "x"), html("One &amp; two", "y", "z"), html("", "w")]))
    (tmp_path / "b.html").write_text(html("", "q"))
    (tmp_path / "c.txt").write_text(html("No", "q"))
    (tmp_path / "d.html").write_text("")
    got = pages.read_pages(spark, str(tmp_path), pages.html_pages, "*.html")
    seen = sorted((r.path.rsplit("/", 1)[-1], r.page, r.total_pages, r.section, r.text, r.table_count) for r in got.collect())
    root = "Introduction/Root"
    assert seen == [("a.html", 1, 3, root, "x\nc", 1), ("a.html", 2, 3, "One & two", "One & two\ny\nz\nc", 1), ("a.html", 3, 3, "One & two", "w\nc", 1), ("b.html", 1, 1, root, "q\nc", 1)]

    def fails(content):
        raise ValueError("not of this kind")

    assert pages.read_pages(spark, str(tmp_path), fails, "*.html").count() == 0


def test_page_files_keep_blank_pages_and_titles_as_the_sql_has_them(spark, tmp_path):
    """References other than those of <, > and &, headings that are no plain <h1>, blank and missing pages, form feeds."""
    import duckdb

    from corpuscle.plans.catalog import oracle_sql, queries

    h = "<html><h1>{}</h1><p>x</p></html>".format
    html = [h("say &quot;a&quot; &amp;lt; b &#x27;c&#x27;"), None, "", h("two  words\t "), " ", "<h2>other</h2>", h(" \u00a0one\u3000"), "<h1>a<b>b</b></h1>" + h("plain"), "\n", h("cut\fhere \x1bf \x1b0"), "\f", None, h(""), "a\fb", "<h1 id='x'>no</h1>", h(" "), None]
    spark.createDataFrame([(i, f"http://a/{i}", t) for i, t in enumerate([x for t in html for x in (t, t, t)])], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = queries()["s1_page_files"](spark, str(tmp_path)).select("file", "page", "total_pages", "section").collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(oracle_sql()["s1_page_files"]).project("file, page, total_pages, section").fetchall())


def test_layout_tells_columns(spark):
    block = lambda x0, y0, x1: ("text", float(x0), float(y0), float(x1), float(y0 + 1), "t")
    two = [block(0, i, 4) for i in range(3)] + [block(6, i, 10) for i in range(3)]
    one = [block(0, i, 10) for i in range(5)]
    rows_ = [("f", "h", 1, 2, "s", "t", 0, two), ("f", "h", 2, 2, "s", "t", 0, one), ("f", "h", 3, 2, "s", "t", 0, [])]
    got = {r.page: (r.n_blocks, round(r.covered, 6), r.multi_column) for r in pages.layout(spark.createDataFrame(rows_, pages.PAGES)).collect()}
    assert got == {1: (6, 0.8, True), 2: (5, 1.0, False)}
