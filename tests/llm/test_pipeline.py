"""The whole result of the pipeline against a brute-force version of it, stage by stage from the documents on."""

from __future__ import annotations

import collections
import random

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corpuscle.llm import pii, quality_cnn, sql

from .test_learned_operators import brute_logit
from .test_text_operators import brute_groups

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents():
    rng = random.Random(12)
    syllables = "th er on an ing ed the and of re".split()
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))
    rows = {i: prose(rng.randint(25, 150)) for i in range(110)}
    for i in range(15):  # exact and near copies
        rows[200 + i] = rows[i]
        words = rows[20 + i].split()
        words[len(words) // 2] = "changed"
        rows[230 + i] = " ".join(words)
    for i in range(50):  # junk
        rows[300 + i] = rows[i].upper().replace(" ", "!! ")
    for i in range(12):  # personal data, and identifiers known by their context only
        rows[400 + i] = f"{prose(40)} write to user{i}@example.org or call +49 30 1234567{i} {prose(20)}"
    rows |= {420: None, 421: "", 422: prose(4_000)}
    return [(i, t, "en", None if i % 10 == 9 else f"s{i % 3}", None if t is None else len(t)) for i, t in rows.items()]


def accepted(net, text):
    logits = np.array(brute_logit(net, text or ""))
    summary = quality_cnn._summary(logits, np.array([0, len(logits)]))[0]
    return 1 / (1 + np.exp(-np.clip(summary @ net.mix + net.mix_bias, -30, 30))) >= quality_cnn.THRESHOLD


def found_values(texts):
    edges, accepted_ = {}, {}
    for t in texts:
        for m in pii.mentions(t or "", pii.base_spans(t or "")):
            for p in m["patterns"]:
                old = edges.get((p, m["value"]), (False, False))
                edges[p, m["value"]] = (old[0] or m["seed"], old[1] or m["refused"])
    for _ in range(pii.ROUNDS):
        known = collections.defaultdict(list)
        for (p, v), (seed, refused) in edges.items():
            score = 1.0 if seed else 0.0 if refused else accepted_.get(v)
            if score is not None:
                known[p].append(score)
        trusted = {p: sum(k) / (len(k) + 1) for p, k in known.items() if sum(x > 0 for x in k) >= pii.MIN_SEEDS and sum(k) / (len(k) + 1) >= pii.MIN_CONFIDENCE}
        wrong = collections.defaultdict(lambda: 1.0)
        for (p, v), (seed, _) in edges.items():
            if not seed and p in trusted:
                wrong[v] *= 1 - min(trusted[p], 0.999)
        accepted_ = {v: 1 - w for v, w in wrong.items() if 1 - w >= pii.MIN_SCORE}
    return set(accepted_)


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(not 300 <= i < 350), 0) for i, *_ in rows if i % 5]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    net = quality_cnn.train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    good = [r for r in rows if accepted(net, r[1])]
    assert 0 < len(good) < len(rows)
    least = {i: root for i, _, root in brute_groups([r[:2] for r in good], 5, 80)}
    single = [r for r in good if least[r[0]] == r[0]]
    assert len(single) < len(good)
    values = found_values([r[1] for r in single])
    masked = [(i, t and pii.mask_text(t, values), lang, source, n) for i, t, lang, source, n in single]
    assert any(t and "[EMAIL]" in t for _, t, *_ in masked)
    con = duckdb.connect()
    con.register("kept", pd.DataFrame(masked, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    con.sql("CREATE VIEW documents AS SELECT * FROM kept")
    mix = con.sql(f"SELECT doc_id, size, taken, target, source_size FROM ({sql.mixture()})").fetchall()
    # a document without words is taken as often as its source is taken whole
    copies = {i: taken // size if size else int(target / whole + 1e-12) if whole else 0 for i, size, taken, target, whole in mix}
    copies = {i: n for i, n in copies.items() if n}
    texts = {i: t for i, t, *_ in masked}

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: coder.encode(texts[i] or "", add_special_tokens=False).ids + [0] for i in copies}
    covered = {i: np.zeros(len(ids[i]), int) for i in copies}
    for r in got.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id])
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert part == ids[r.doc_id][r.start : r.start + len(part)]
        covered[r.doc_id][r.start : r.start + len(part)] += 1
    assert {i: set(c) for i, c in covered.items()} == {i: {n} for i, n in copies.items()}
    assert set(got.doc_id) == set(copies) and max(copies.values()) == 2
    got["n"] = got["ids"].map(len) // 4
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        total = part["n"].sum()
        assert part["offset"].tolist() == [0, *np.cumsum(part["n"])[:-1]] and total <= 1024 and total & (total - 1) == 0
