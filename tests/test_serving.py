"""Joins and rules around a service on hand-made rows."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import rules
from corpuscle.operators import serving as V
from corpuscle.operators import vectors
from corpuscle.sources import services, snapshots


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_citations_prefer_the_section(spark):
    docs = spark.createDataFrame([(1, 5, "Intro"), (2, 5, "2 Methods used"), (3, 6, None)], "doc_id int, page int, section string")
    cited = spark.createDataFrame([("a", 5, "Methods"), ("b", 5, "Other"), ("c", 6, "x"), ("d", 7, "x"), ("e", 5, ""), ("f", 5, None)], "k string, page int, section string")
    assert rows(V.cite(cited, docs, ["k"])) == [("a", 2), ("b", 1), ("c", 3), ("e", 1), ("f", 1)]


def test_lines_round_halves_to_even_and_drop_empty_ones(spark):
    words = spark.createDataFrame([(1, 0.0, 4.0, 5.0, 9.0), (1, 6.0, 3.0, 9.0, 8.0), (1, 0.0, 12.0, 4.0, 20.0), (1, 1.0, 30.0, 1.0, 38.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert rows(V.lines_of(words)) == [(1, 0.0, 0.0, 3.0, 9.0, 6.0, 2), (1, 16.0, 0.0, 12.0, 4.0, 8.0, 1)]


def test_highlights_hit_beyond_half(spark):
    df = spark.createDataFrame([(1, "The quick fox", "a QUICK brown fox"), (2, "one two three", "one"), (3, "a b", "a b"), (4, None, "x"), (5, "word", None)], "k int, e string, x string")
    assert rows(V.highlight_hits(df, ["k"], F.col("e"), F.col("x"))) == [(1, 3, 0.666667, True), (2, 3, 0.333333, False), (3, 0, 0.0, False), (4, 0, 0.0, False), (5, 1, 0.0, False)]


def test_references_go_on_to_the_end_of_their_document(spark):
    df = spark.createDataFrame([(1, 0, "text"), (1, 1, "## References\n[1]"), (1, 2, "more"), (2, 0, "isbn 1"), (2, 1, "a" + "," * 26), (2, 2, None), (2, 3, "doi:" * 3)], "d int, c int, text string")
    got = {(r.d, r.c): (r.is_reference, r.is_content) for r in V.tag_content(df, ["d"], "c").collect()}
    assert got == {(1, 0): (False, True), (1, 1): (True, False), (1, 2): (True, False), (2, 0): (False, False), (2, 1): (False, False), (2, 2): (False, True), (2, 3): (False, False)}


def test_access_reasons(spark):
    users = spark.createDataFrame([(1, True, False), (2, False, False), (3, True, True), (4, True, False), (5, True, False)], "user_id int, is_active boolean, is_locked boolean")
    members = spark.createDataFrame([(1, "r"), (2, "r"), (3, "r"), (4, "admin"), (4, "r"), (6, "r")], "user_id int, role string")
    roles = spark.createDataFrame([("r", False), ("admin", True)], "role string, is_admin boolean")
    grants = spark.createDataFrame([("r", "read", "doc", None), ("r", "write", "doc", "7"), ("s", "drop", "doc", None)], "role string, action string, resource string, resource_id string")
    asked = [(1, "read", "doc", "1"), (1, "write", "doc", "7"), (1, "write", "doc", "8"), (1, "write", "doc", None), (2, "read", "doc", "1"), (3, "read", "doc", "1"), (4, "any", "x", None), (5, "read", "doc", "1"), (6, "read", "doc", "1")]
    q = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "q int, user_id int, action string, resource string, resource_id string")
    got = [r.reason for r in V.check_access(q, ["q"], users, members, roles, grants).orderBy("q").collect()]
    assert got == [None, None, "no_permission", "no_permission", "user_inactive", "user_locked", None, "no_permission", "user_not_found"]
    held = rows(V.permissions(members, roles, grants).where("user_id in (1, 4)"))
    assert len([h for h in held if h[0] == 1]) == 2 and len([h for h in held if h[0] == 4]) == 3


def test_messages_reach_subscribers_once_and_not_their_sender(spark):
    messages = spark.createDataFrame([(1, "a", 9), (2, "b", 8), (3, "a", None)], "message_id int, channel string, sender int")
    held = spark.createDataFrame([(8, "a"), (8, "a"), (9, "a"), (8, "b")], "client_id int, channel string")
    assert rows(V.broadcast_messages(messages, held)) == [(1, 8), (3, 8), (3, 9)]


@pytest.mark.parametrize("most", [0, 100])
def test_broadcast_goes_out_in_packs(spark, monkeypatch, most):
    monkeypatch.setattr(V, "BROADCAST_CLIENTS", most)
    sent = spark.range(900).select(F.col("id").alias("message_id"), (F.col("id") % 3).cast("int").alias("channel"), (F.col("id") % 50).alias("sender"))
    held = spark.range(60).select(F.col("id").alias("client_id"), (F.col("id") % 4).cast("int").alias("channel"))
    got = [tuple(r) for r in V.broadcast_messages(sent, held.union(held)).collect()]
    assert sorted(got) == sorted((m, c) for m in range(900) for c in range(60) if m % 3 == c % 4 and c != m % 50)
    assert sum(a[1] != b[1] for a, b in zip(got, got[1:])) < len(got) / 20  # a pack at a time


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_a_pack_goes_to_some_clients_at_a_time(spark, monkeypatch, kind):
    """Ids of any kind, missing ones too; no step makes a pack's rows for all clients of a channel before it hands on the first."""
    for name, value in (("PACK", 8), ("GROUP", 5), ("HELD", 20)):
        monkeypatch.setattr(V, name, value)
    sent = spark.range(90).selectExpr(f"cast(if(id = 80, null, id) as {kind}) message_id", "id % 3 channel", f"cast(if(id % 7 = 0, null, id % 20) as {kind}) sender")
    held = spark.range(61).selectExpr(f"cast(if(id = 60, null, id) as {kind}) client_id", "id % 4 channel")
    got = V.broadcast_messages(sent, held)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    text = lambda x: None if x is None else str(x)
    want = Counter((text(None if m == 80 else m), text(None if c == 60 else c)) for m in range(90) for c in range(61) if m % 3 == c % 4 and (None if c == 60 else c) != (None if m % 7 == 0 else m % 20))
    assert Counter((text(r.message_id), text(r.client_id)) for r in got.collect()) == want and dict(got.dtypes) == {"message_id": kind, "client_id": kind}
    assert V.broadcast_messages(sent, held.where("channel > 9")).count() == 0


def test_tiers_promote_what_comes_from_below(spark):
    t = lambda *kv: spark.createDataFrame(list(kv), "key string, value string")
    asked = spark.createDataFrame([("a", False), ("b", False), ("c", False), ("a", True), ("c", True)], "key string, by_meaning boolean")
    got = rows(V.tiered_lookup(asked, t(("a", "m")), t(("a", "s")), t(("a", "d"), ("b", "d"), ("c", None))))
    assert got == [("a", False, "m", "memory", False), ("a", True, "s", "semantic", True), ("b", False, "d", "disk", True), ("c", False, None, "miss", False), ("c", True, None, "miss", False)]


def test_retention_and_liveness(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    records = spark.createDataFrame([(1, day(1)), (2, day(20))], "k int, at timestamp")
    artefacts = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    now = F.lit(day(21))
    assert rows(V.retention(records, artefacts, "k", "at", now, 10)) == [(1, "artefact", "old"), (1, "record", "old"), (3, "artefact", "orphan")]
    beats = spark.createDataFrame([(1, "node", day(20)), (1, "node", day(19)), (2, "client", day(20)), (3, "other", day(1))], "k int, kind string, at timestamp")
    got = {r.k: (r.silent, r.expired) for r in V.liveness(beats, "k", "at", now, {"node": 60.0, "client": 1e6}).collect()}
    assert got == {1: (86400.0, True), 2: (86400.0, False), 3: (20 * 86400.0, False)}


@pytest.mark.parametrize(("strategy", "want"), [("exponential", [1, 2, 4, 60]), ("linear", [1, 2, 3, 11]), ("fixed", [1, 1, 1, 1]), ("immediate", [0, 0, 0, 0])])
def test_retry_delays(spark, strategy, want):
    df = spark.createDataFrame([(0,), (1,), (2,), (10,)], "n int")
    assert [r.d for r in df.orderBy("n").select(V.retry_delay(F.col("n"), strategy).cast("double").alias("d")).collect()] == want


def test_jobs_and_expansions(spark):
    jobs = spark.createDataFrame([(1, 1, "completed"), (1, 2, "completed"), (2, 3, "failed"), (2, 4, "pending"), (3, 5, "pending"), (4, 6, "pending"), (4, 7, "completed")], "group_id int, job_id int, status string")
    assert {r.group_id: (r.status, r.complete) for r in V.group_status(jobs).collect()} == {1: ("completed", True), 2: ("failed", False), 3: ("pending", False), 4: ("processing", False)}
    told = {r.job_id: (r.status, r.refused) for r in V.cancelled(jobs, jobs.where("job_id in (1, 4)")).collect()}
    assert told[1] == ("completed", True) and told[4] == ("cancelled", False) and told[5] == ("pending", False)
    q = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "query_id int, text string")
    says = F.when(F.col("query_id") == 1, "a\n\n- no\n b ").when(F.col("query_id") == 2, "y")
    assert rows(V.expand(q, lambda d: d.withColumn("expansion", says))) == [(1, False, 0, "a"), (1, False, 1, "b"), (2, True, 0, "y"), (3, True, 0, "z")]
    assert V.batch_rows(1000, 100_000) == 64 and V.batch_rows(1e9, 1) == 16 and V.batch_rows(1, 1e12) == 4096


def test_evaluation(spark):
    df = spark.createDataFrame([(1, "|---| x | --- |", 1), (1, "", 3), (2, None, 0)], "k int, text string, table_count int")
    assert rows(V.table_quality(df, ["k"])) == [(1, 4, 2, 50.0), (2, 0, 0, 0.0)]
    pages = spark.createDataFrame([(i, "s", "w" * (150 + 20 * i)) for i in range(9)], "page_id int, source string, text string")
    got = V.question_set(pages, lambda p: p.withColumns({"question": F.when(F.col("page_id") != 5, "q"), "answer": F.lit("a")}), per_source=9).collect()
    assert {r.page_id for r in got} == {3, 4, 6, 7, 8} and V.question_set(pages, lambda p: p.withColumns({"question": F.lit("q"), "answer": F.lit("a")}), 2).count() == 2


def test_a_success_forgets_failures_and_old_ones_do_not_count(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    tries = [(0, False), (10, False), (20, False), (30, True), (40, False), (50, False), (110, False), (111, False), (112, False)]
    df = spark.createDataFrame([("u", at(s), ok) for s, ok in tries] + [("v", at(5), False)], "u string, t timestamp, ok boolean")
    got = rules.lockouts(df, "u", "t", "ok", most=3, seconds=70).where("u = 'u'").orderBy("t").collect()
    assert [(r.failures, r.locked) for r in got] == [(1, False), (2, False), (3, True), (0, False), (1, False), (2, False), (2, False), (3, True), (4, True)]


def test_health_settings_splits_and_clips(spark):
    nodes = spark.createDataFrame([(1, 10.0, 20.0), (2, 80.0, 20.0), (3, None, 20.0)], "k int, cpu double, memory double")
    assert [r.k for r in rules.healthy(nodes, {"cpu": 80, "memory": 85}).collect()] == [1]
    df = spark.createDataFrame([(1, 100, 99), (2, 99, 200), (3, None, 5)], "k int, size int, overlap int")
    got = rows(rules.violations(df, "k", {"size": (100, 2000)}, {"overlap reaches the size": F.col("overlap") >= F.col("size")}))
    assert got == [(2, "overlap reaches the size"), (2, "size not in 100..2000"), (3, "size not in 100..2000")]
    chunks = spark.createDataFrame([(1, "x" * 15), (1, "x" * 16), (2, "x" * 15), (3, None)], "k int, t string")
    assert rows(rules.needs_split(chunks, ["k"], "t", 10)) == [(1, 16, True), (2, 15, False), (3, 0, False)]
    text = spark.createDataFrame([("a\n\n \n\nb\n\nc",), ("x" * 50,), ("",)], "t string")
    assert [r[0] for r in text.select(rules.clipped(F.col("t"), parts=2, chars=20)).collect()] == [["a", "b"], ["x" * 20], [""]]


def test_reports_and_performance_log(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 1.0)], "k int, score double")
    services.write_report(df, "k", ["score"], f"{tmp_path}/r")
    assert rows(services.read_report(spark, f"{tmp_path}/r", ["score"])) == [("1", 0.5, "detail"), ("2", 1.0, "detail"), ("mean", 0.75, "summary")]
    said = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), 1.23456, 2.34567, 'a "quoted", ' + "x" * 200)], "timestamp timestamp, ttft double, tps double, query string")
    snapshots.write_performance_csv(said, f"{tmp_path}/p")
    got = snapshots.read_performance_csv(spark, f"{tmp_path}/p").first()
    assert tuple(got)[:8] == ("2024-01-02 03:04:05", "unknown", 1.235, 0.0, 0.0, 0.0, 0, 2.35) and got.Query == ('a "quoted", ' + "x" * 200)[:100]


def test_reference_keys_of_all_forms(spark):
    text = "[1] One.\n(2) Two\n3. Three\n4 no point\nplain\n\nSmith et al. (2020) wrote.\n\nIn Jones, 1999 and Lee (2001)\n\nnobody 123"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(T.reference_keys(F.col("t"))).alias("k")).select("k.*").collect()
    assert [tuple(r) for r in got] == [("1", "One."), ("2", "Two"), ("3", "Three"), ("4", "no point"), ("smith_2020", "Smith et al. (2020) wrote."), ("jones_1999", "In Jones, 1999 and Lee (2001)")]


def test_similar_pairs_of_one_large_cell_over_salts(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "MET", 2)
    rng = np.random.default_rng(1)
    v = np.abs(rng.standard_normal((300, 3)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 6)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if cosine[i, j] >= 0.999}
    for cells in (1, 5):
        assert {(r.a, r.b) for r in vectors.similar_pairs(df, "id", "v", 0.999, cells).collect()} == want
