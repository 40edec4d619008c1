"""Chat formatting, sharding, mixing and quality rules against brute force."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.llm import chat_format, mixing, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, source string, shard int, _u double"  # extra columns with clashing names


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], DOCS)


HARD = ["</s>", "\\", "\\\\", "<|turn|>user<|text|>x<|end|>", "\\<|end|>", "[INST]\\[/INST]", "<<SYS>>\\", "a\nb", "", None, "<<s>", "<s>\\<s>", "<", "[", "<\\", "[\\", "\\[/INST]", "<\\\\|x"]


def test_chat_round_trip_and_loss(spark):
    rows = [(1, i, "assistant" if i % 2 else "user<|end|>\\", t) for i, t in enumerate(HARD)] + [(2, 0, None, "only"), (None, 0, "assistant", "x"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit(1))
    want = collections.defaultdict(list)
    for conv, _, role, text in rows:
        want[conv].append((role or "", text or ""))
    got = {r.conv_id: r for r in chat_format.digests(turns).collect()}
    assert got.keys() == want.keys()
    for conv, said in want.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert got[conv].n_turns == len(said)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].n_examples == sum(r == "assistant" for r, _ in said)


def test_chat_examples_hold_all_preceding_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "z")], "conv_id long, turn long, role string, text string")
    rendered = chat_format.render(turns)
    whole = rendered.first().formatted
    rows = sorted(chat_format.expand(rendered).collect(), key=lambda r: r.example)
    assert [r.target for r in rows if r.trainable] == ["a", "b"]
    assert all(whole.startswith(r.context + r.target) for r in rows)
    assert rows[-1].context + rows[-1].target == whole and not rows[-1].trainable
    assert [r["last"] for r in rows] == [False, False, True]
    chars = sum(len(r.context) + len(r.target) + len(chat_format.END) if r.trainable else len(r.target) for r in rows)
    assert chat_format.digests(turns).first().formatted_chars == chars


def test_chat_of_a_very_long_conversation(spark):
    """Every example has its whole context, and every turn is read back, however long the conversation is."""
    said = [("assistant" if i % 2 else "user", f"{i} " + "long text " * 2000) for i in range(60)]
    turns = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string")
    got = chat_format.digests(turns).first()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    sizes = [len(f"<|turn|>{r}<|text|>{t}<|end|>") for r, t in said]
    assert got.formatted_chars == sum(sum(sizes[: i + 1]) for i in range(1, 60, 2))
    assert chat_format.expand(chat_format.render(turns)).where("context is null or length(context) = 0").count() == 0


def test_chat_digests_read_the_examples_contexts(spark, monkeypatch):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    want, expand = chat_format.digests(turns).first(), chat_format.expand
    monkeypatch.setattr(chat_format, "expand", lambda *a: expand(*a).withColumn("context", F.replace("context", F.lit("q"), F.lit("lost"))))
    got = chat_format.digests(turns).first()
    assert got.turns_sha256 != want.turns_sha256 and got.loss_sha256 == want.loss_sha256


def test_chat_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(empty).count() == 0


def test_sharding_counts_slots_and_mixture(spark):
    rows = [(i, f"text {i}", f"s{min(i % 9, 3)}") for i in range(997)] + [(5, "again", "s1"), (5, "again", "s1"), (None, None, None), (7, "", None)]
    got = sharding.stratified_interleave(docs_of(spark, rows), shards=10, buckets=16).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 10 and sizes.max() - sizes.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    source = {i: s for i, _, s in rows[:997]}
    spread = got[got["doc_id"].isin(range(997))].assign(s=lambda d: d["doc_id"].map(source)).groupby(["shard", "s"]).size().unstack(fill_value=0)
    assert (spread.max() - spread.min() <= 3).all()
    text = {i: t for i, t, _ in rows[:997]}
    for r in got[got["doc_id"].isin(range(10, 997))].itertuples():
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    again = sharding.stratified_interleave(docs_of(spark, rows[::-1]), shards=10, buckets=999).toPandas()
    key = ["doc_id", "size", "shard", "slot"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert sharding.stratified_interleave(docs_of(spark, [])).count() == 0


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Resharing until nothing is above, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s]] if total else []
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)


@pytest.mark.parametrize("skew", [1, 40])
def test_mixing_meets_targets(spark, skew):
    rows = [(i, "w " * (1 + i * 7919 % (60 if i % 5 else 400)), ["a", "b", "c", None][min(i % (3 + skew), 3)]) for i in range(1500)] + [(-1, None, "a"), (-2, "", "z"), (3, "w w", "a")]
    got = mixing.mix(docs_of(spark, rows), buckets=32).toPandas()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(dict(sizes))
    for s, part in got.groupby("source", dropna=False):
        s = None if s != s or s is None else s
        assert part["target"].iloc[0] == pytest.approx(want[s])
        assert abs(part["taken"].sum() - want[s]) <= max(2, 0.005 * want[s])
    assert (got["taken"] <= 2 * got["size"]).all()
    again = mixing.mix(docs_of(spark, rows[::-1]).repartition(7), buckets=32).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_mixing_repeats_rows_as_decided(spark):
    rows = [(i, "w " * (1 + i * 31 % 50), f"s{i % 4}") for i in range(300)]
    docs = docs_of(spark, rows)
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
    assert mixing.mix(docs_of(spark, [])).count() == 0 and mixing.repeat(docs_of(spark, [])).count() == 0


def test_mixing_follows_the_pareto_key(spark):
    """Inclusion odds differ by size, so the taken are the first by key, not by random number, and repeated rows go together."""
    rows = [(i, "w " * (1 if i % 2 else 100), "a") for i in range(2000)] + [(5000, "w w", "b")] * 300
    docs = docs_of(spark, rows)
    got = mixing.mix(docs, weights=(1, 3), share=0.4).toPandas()
    short, long = got[got["size"] == 1], got[got["size"] == 100]
    assert (short["copies"] > 0).mean() > (long["copies"] > 0).mean() + 0.2
    assert got[got["source"] == "b"]["copies"].nunique() == 1
    assert mixing.repeat(docs, weights=(1, 3), share=0.4).count() == got["copies"].sum()
    key = spark.createDataFrame([(0.25, 16.0, 4, 0.5)], "f double, mean double, size long, u double")
    p = mixing.inclusion(key["size"], key["f"], key["mean"])
    assert key.select(p.alias("p"), mixing.pareto_key(key["u"], p).alias("q")).first().asDict() == pytest.approx({"p": 0.4, "q": 1.5})


def test_native_operators_on_a_very_long_text(spark):
    long = "and the word " * 200_000
    rows = [(1, long, "a"), (2, long, "a"), (3, "the short one", "a"), (4, None, None), (5, "x" * 3_000_000, "\x00null")]
    docs = docs_of(spark, rows)
    shards = {r.doc_id: r for r in sharding.stratified_interleave(docs, shards=2).collect()}
    assert shards[1].size == len(long) + 16 and shards[1].text_crc32 == zlib.crc32(long.encode())
    mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert (mixed[1].size, mixed[5].size, mixed[4].size) == (600_000, 1, 0)
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert rules[1].n_words == rules[1].n_repeat_words == 600_000 and rules[5].word_chars == 3_000_000


def test_quality_rules_of_nothing(spark):
    assert quality_rules.quality_rules(docs_of(spark, [])).count() == 0


def quality(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def check_quality(spark, texts):
    got = quality_rules.quality_rules(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).toPandas().sort_values("doc_id")
    for r, t in zip(got.itertuples(), texts, strict=True):
        n, chars, symbols, dup, rep = quality(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), t
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.kept and r.base_failed)
    return got


def test_quality_counts(spark):
    prose = "the cat sat on the mat and it was good for all of us to see that by day and night\n"
    texts = [None, "", " \n\t", "a b c d e f g h a b c d e f g h", "x " * 40, "a b c d e f g h i " * 3, prose, prose * 3, "a\x0bb\x0cc\x1fd \u00a0e", "é ü ß\n\n \né ü ß", "one two three four five six seven eight " + " ".join(map(str, range(30))) + " one two three four five six seven eight", "# * $ | < >", prose + "word " + "y" * 50_000]
    got = check_quality(spark, texts)
    assert got["kept"].iloc[6]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n|$", max_size=120), min_size=1, max_size=12))
def test_quality_counts_property(spark, texts):
    check_quality(spark, texts)


def test_quality_drops_junk(spark):
    junk = ["THIS IS ALL LOUD AND NO ONE WILL READ IT!! " * 3 + " ".join(f"W{i}!!" for i in range(30)), " | ".join(f"cell{i} and the" for i in range(30)), " ".join(f"the{i}$$$ of***" for i in range(30))]
    assert not quality_rules.quality_rules(docs_of(spark, [(i, t, "s") for i, t in enumerate(junk)])).where("kept").count()
