"""Language identification and the quality network: held-out accuracy and defined results for odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpuscle.llm import language_id, quality_cnn
from corpuscle.llm.common import texts_of

SYLLABLES = {"en": "th er on an ing ed the and of tion".split(), "de": "sch ein ch ung der und die keit".split(), "es": "ción os la que mente ado ñ el".split(), "fr": "eau é è les ment que aux oi".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def table(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text, quality = prose(rng, lang, rng.randint(5, 200)), 1
        if i % 4 == 0:
            text, quality = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), text.replace(" ", " | ")]), 0
        rows.append((i, text, lang, quality, 0.5))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, quality int, score double"), rows


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len(code) == n and len({tuple(r) for r in code.tolist()}) == n
    if n > 2:
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 2


def test_language_held_out_accuracy(spark):
    docs, rows = table(spark)
    odd = spark.createDataFrame([(10_000, None, "en", 1, 0.0), (10_001, "", "en", 1, 0.0), (10_002, "123 !?", None, 1, 0.0), (10_003, "the thing and the other " * 20_000, "en", 1, 0.0)], docs.schema)
    got = {r.doc_id: r for r in language_id.identify(docs.unionByName(odd)).collect()}
    assert len(got) == len(rows) + 4
    right = [got[i].lang_pred == lang for i, _, lang, *_ in rows if held(i)]
    assert np.mean(right) > 0.97
    assert all(got[i].held_out == held(i) for i in got)
    assert [got[i].lang_pred for i in (10_000, 10_001, 10_002)] == ["und"] * 3 and got[10_003].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert language_id.identify(docs).first().lang_pred == "und"


def test_language_long_text_is_read_in_pieces():
    rng = random.Random(3)
    import pandas as pd

    model = language_id.fit(pd.DataFrame([{"text": prose(rng, v, 80), "lang": v} for v in SYLLABLES for _ in range(20)]))
    text = prose(rng, "de", 60_000)
    raw, offsets = texts_of(pa.array([text, "kurz und ein"]))
    assert len(raw) > language_id.PIECE
    whole = np.bincount(language_id.ngram_ids(raw[: offsets[1]]).ravel(), minlength=1 << language_id.BITS)
    want = np.sqrt(whole / offsets[1]) @ model.weights + model.bias
    assert language_id._margins(model, raw, offsets)[0] == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_network_held_out_accuracy_and_pipeline_filter(spark):
    docs, rows = table(spark)
    labels = docs.select("doc_id", "quality")
    net = quality_cnn.train(docs.drop("quality"), labels)
    got = {r.doc_id: r for r in quality_cnn.classify(docs, net).collect()}
    right = [got[i].predicted == q for i, _, _, q, _ in rows if held(i)]
    assert np.mean(right) > 0.95
    assert all((r.score >= 0.7) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got.values())
    kept = quality_cnn.keep_good(docs, net)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_network_scores_texts_alone_or_together():
    import pandas as pd

    rng = random.Random(5)
    rows = pd.DataFrame([{"text": prose(rng, "en", 50).upper() if i % 2 else prose(rng, "en", 50), "quality": 1 - i % 2} for i in range(60)])
    net = quality_cnn.fit(rows, epochs=4)
    texts = ["", "a", "the end " * 30, prose(rng, "fr", 90_000), "é" * 255, "x" * 256, "x" * 257]
    together = quality_cnn.score_texts(net, *texts_of(pa.array(texts)))
    for t, score in zip(texts, together, strict=True):
        assert quality_cnn.score_texts(net, *texts_of(pa.array([t])))[0] == pytest.approx(score, abs=1e-5)


def brute_logit(net, text):
    """The network's chunks one by one."""
    raw = text.encode()
    size = quality_cnn.SEGMENT
    count = (len(raw) + quality_cnn.WIDTH + size - 1) // size
    raw += bytes(count * size + quality_cnn.WIDTH - len(raw))
    act = lambda p: net.table[list(raw[p : p + quality_cnn.WIDTH].ljust(quality_cnn.WIDTH, b"\0"))].reshape(-1) @ net.filters
    pooled = [np.max([act(p) for p in range(s * size, (s + 1) * size, quality_cnn.STRIDE)], axis=0) for s in range(count)]
    chunks = [np.maximum(pooled[s], pooled[min(s + 1, count - 1)]) for s in range(count)]
    return [float(np.maximum(c + net.bias, 0) @ net.out + net.out_bias) for c in chunks]


def test_network_matches_brute_force():
    import pandas as pd

    rng = random.Random(6)
    net = quality_cnn.fit(pd.DataFrame([{"text": prose(rng, "en", 30), "quality": i % 2} for i in range(20)]), epochs=1)
    texts = ["", "abc", prose(rng, "es", 130), "y" * 600]
    logits, borders = quality_cnn.chunk_logits(net, *texts_of(pa.array(texts)))
    for i, t in enumerate(texts):
        assert logits[borders[i] : borders[i + 1]] == pytest.approx(brute_logit(net, t), abs=1e-3)


def test_network_without_labels(spark):
    docs = spark.createDataFrame([(1, "text"), (2, None)], "doc_id bigint, text string")
    net = quality_cnn.train(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert net is None
    assert [r.score for r in quality_cnn.classify(docs, net).collect()] == [0.5, 0.5]
    assert quality_cnn.keep_good(docs, net).count() == 2


def test_decoding_matches_brute_force():
    """The nearest codeword by loss weighted by each bit's trust, its share, and the ambiguity flag, one row at a time."""
    rng = np.random.default_rng(4)
    code = language_id.codewords(7)
    trust = rng.random(code.shape[1])
    model = language_id.Model([f"l{i}" for i in range(7)], code, np.zeros((1, code.shape[1])), np.zeros(code.shape[1]), trust / trust.sum())
    margins = rng.normal(0, 2, (200, code.shape[1]))
    place, score, ambiguous = language_id.decode(model, margins)
    for k, row in enumerate(margins):
        loss = [sum(model.trust[b] * np.log1p(np.exp(-code[i, b] * row[b])) for b in range(code.shape[1])) for i in range(7)]
        share = [np.exp(-4 * (v - min(loss))) for v in loss]
        first, second = sorted(share, reverse=True)[:2]
        assert place[k] == loss.index(min(loss)) and score[k] == pytest.approx(first / sum(share))
        assert ambiguous[k] == (first / (first + second) < language_id.CLEAR)
    exact = language_id.decode(model, 50.0 * code)
    assert exact[0].tolist() == list(range(7)) and not exact[2].any()


def test_learned_operators_on_empty_tables(spark):
    none = table(spark, 1)[0].where("false")
    assert language_id.identify(none).count() == 0
    assert quality_cnn.train(none, none.select("doc_id", "quality")) is None
    assert quality_cnn.classify(none, None).count() == 0 and quality_cnn.keep_good(none, None).columns == none.columns


def test_training_samples_hold_whole_texts(spark):
    from corpuscle.llm.learning import sample

    long = "some words of a long text " * 4000
    docs = spark.createDataFrame([(1, long, "a"), (4, None, "b")], "doc_id bigint, text string, lang string")
    got = sample(docs, docs.select("doc_id", "lang"), "lang")
    assert {r.doc_id: r.text for r in got.itertuples()} == {i: t for i, t in ((1, long), (4, "")) if not held(i)}


def test_the_fit_reads_its_sample_in_pieces(monkeypatch):
    """Before, index arrays over all bytes of the sample took three times eight bytes each on the driver."""
    import numpy as np
    import pandas as pd

    from corpuscle.llm import quality_cnn as Q

    sizes, whole = [], Q.chunk_logits
    monkeypatch.setattr(Q, "chunk_logits", lambda net, raw, offsets: (sizes.append(len(raw)), whole(net, raw, offsets))[1])
    rows = pd.DataFrame({"text": ["good words here " * 4000, "### %%% " * 8000] * 8, "quality": [1, 0] * 8})
    net = Q.fit(rows, epochs=1)
    assert max(sizes) <= Q.PIECE and np.isfinite(net.mix).all()
