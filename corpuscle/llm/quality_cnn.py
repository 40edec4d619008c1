"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded, and learned filters slide over them. Activations are max-pooled over chunks of 512 bytes
that overlap by half and cover the whole text; each chunk's pooled vector gives a logit, and the mean, the least and the
greatest of a text's logits are combined into one probability by a small logistic layer.

Training: at most PER_LABEL documents of either label (see learning.sample), balanced, never held-out rows; random chunks,
Adam, gradients through the maxima. Seeded, so the same rows give the same network.

Scale: the labels and ids are sampled first, then the sampled texts are read by a broadcast of a bounded number of ids.
Scoring is one scan without a shuffle. Memory is bounded by a piece of half a megabyte, also within a very long text.

Null or empty text: scored like a text of no bytes. No labels of both kinds: every score is 0.5. Equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, texts_of, tidy
from .learning import PER_LABEL, held_out, logistic, sample

WIDTH, EMBED, FILTERS, STRIDE = 6, 6, 24, 2
SEGMENT = 256  # a chunk is two neighbouring segments
PIECE = 1 << 18
THRESHOLD = 0.7
#: Share of training chunks that are cut short, so that little text is no sign of a bad one.
SHORTENED = 0.5


@dataclass
class Network:
    table: np.ndarray  # 256 by EMBED
    filters: np.ndarray  # WIDTH * EMBED by FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    mix: np.ndarray  # of mean, least and greatest logit
    mix_bias: float


def _windows(net: Network, raw: np.ndarray) -> np.ndarray:
    """Embedded windows at every STRIDE-th byte of rows of bytes (rows by length); the last WIDTH - STRIDE bytes begin none."""
    x = net.table[raw]
    seen = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STRIDE]  # rows, places, EMBED, WIDTH
    return np.ascontiguousarray(seen.transpose(0, 1, 3, 2)).reshape(len(raw), -1, WIDTH * EMBED)


def chunk_logits(net: Network, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all chunks of the texts, and the borders of the texts among them.

    A text fills whole segments with zeros behind it; a segment's windows look into the next segment of its own text only.
    """
    size = np.diff(offsets)
    count = (size + WIDTH + SEGMENT - 1) // SEGMENT
    borders = np.append(0, np.cumsum(count))
    padded = np.zeros(int(borders[-1]) * SEGMENT, np.uint8)
    padded[np.arange(len(raw)) + np.repeat(borders[:-1] * SEGMENT - offsets[:-1], size)] = raw
    rows = padded.reshape(-1, SEGMENT)
    ahead = np.zeros((len(rows), WIDTH - STRIDE), np.uint8)
    ahead[:-1] = rows[1:, : WIDTH - STRIDE]
    ahead[borders[1:] - 1] = 0
    rows = np.concatenate([rows, ahead], 1)
    step = PIECE // SEGMENT
    parts = [(_windows(net, rows[i : i + step]) @ net.filters).max(1) for i in range(0, len(rows), step)]
    pooled = np.concatenate(parts) if parts else np.zeros((0, FILTERS), np.float32)
    nxt = np.arange(1, len(pooled) + 1)
    nxt[borders[1:] - 1] -= 1  # a text's last segment is followed by none
    chunks = np.maximum(pooled, pooled[nxt])
    return np.maximum(chunks + net.bias, 0) @ net.out + net.out_bias, borders


def _summary(logits: np.ndarray, borders: np.ndarray) -> np.ndarray:
    at = borders[:-1]
    return np.stack([np.add.reduceat(logits, at) / np.diff(borders), np.minimum.reduceat(logits, at), np.maximum.reduceat(logits, at)], 1)


def score_texts(net: Network | None, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each text."""
    if net is None:
        return np.full(len(offsets) - 1, 0.5)
    parts = [1 / (1 + np.exp(-np.clip(part @ net.mix + net.mix_bias, -30, 30))) for part in summaries(net, raw, offsets)]
    return np.concatenate([np.zeros(0), *parts])


def summaries(net: Network, raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Mean, least and greatest logit of each text, for texts of about PIECE bytes together at a time."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1)
        yield _summary(*chunk_logits(net, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        i = j


def fit(rows: pd.DataFrame, odds: float = 1.0, epochs: int = 48, batch: int = 64, rate: float = 4e-3, seed: int = 3) -> Network | None:
    """A network from rows of text and quality; None without both labels. odds: of label 1 among all labelled rows."""
    rows = rows[rows["quality"].isin([0, 1])] if len(rows) else rows
    if not len(rows) or rows["quality"].nunique() < 2:
        return None
    rng = np.random.default_rng(seed)
    texts = [np.frombuffer(t.encode(), np.uint8) for t in rows["text"]]
    y = rows["quality"].to_numpy().astype(np.float32)
    even = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y == 0).mean()).astype(np.float32)
    net = Network(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, FILTERS).astype(np.float32), 0.0, np.array([1.0, 0, 0]), 0.0,
    )
    names = ("table", "filters", "bias", "out")
    m = {k: np.zeros_like(getattr(net, k)) for k in names} | {"out_bias": 0.0}
    v = {k: np.zeros_like(getattr(net, k)) for k in names} | {"out_bias": 0.0}
    chunk, t = 2 * SEGMENT, 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            picked = order[at : at + batch]
            raw = np.zeros((len(picked), chunk + WIDTH - STRIDE), np.uint8)
            for r, i in enumerate(picked):
                start = SEGMENT * int(rng.integers(0, max(1, (len(texts[i]) + WIDTH + SEGMENT - 1) // SEGMENT)))
                part = texts[i][start : start + (int(chunk * np.exp(-4 * rng.random())) if rng.random() < SHORTENED else chunk)]
                raw[r, : len(part)] = part
            win = _windows(net, raw)
            act = win @ net.filters
            top = act.argmax(1)  # rows by FILTERS
            hidden = np.take_along_axis(act, top[:, None], 1)[:, 0] + net.bias
            relu = np.maximum(hidden, 0)
            p = 1 / (1 + np.exp(-np.clip(relu @ net.out + net.out_bias, -30, 30)))
            e = ((p - y[picked]) * even[picked] / len(picked)).astype(np.float32)
            g = {"out": relu.T @ e + 1e-4 * net.out, "out_bias": float(e.sum())}
            back = e[:, None] * net.out * (hidden > 0)
            g["bias"] = back.sum(0)
            best = win[np.arange(len(picked))[:, None], top]  # rows, FILTERS, WIDTH * EMBED
            g["filters"] = np.einsum("bf,bfk->kf", back, best)
            own = (back[:, :, None] * net.filters.T[None]).reshape(len(picked), FILTERS, WIDTH, EMBED)
            table = np.zeros_like(net.table)
            bytes_ = raw[np.arange(len(picked))[:, None, None], top[:, :, None] * STRIDE + np.arange(WIDTH)]
            np.add.at(table, bytes_.ravel(), own.reshape(-1, EMBED))
            g["table"] = table
            t += 1
            for k in g:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                setattr(net, k, getattr(net, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))
    offsets = np.append(0, np.cumsum([len(x) for x in texts]))
    w, b = logistic(np.concatenate([*summaries(net, np.concatenate(texts), offsets)]), (y > 0)[:, None], even, l2=1e-3, steps=300, rate=0.05)
    net.mix, net.mix_bias = w[:, 0].astype(float), float(b[0]) + float(np.log(odds))  # the sample is balanced, the rows are not
    return net


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Network | None:
    """A network from documents (doc_id, text) and labels (doc_id, quality)."""
    usable = labels.select("doc_id", "quality").where(~held_out())
    count = {r["quality"]: r["count"] for r in usable.where(F.col("quality").isin(0, 1)).groupBy("quality").count().collect()}
    odds = count.get(1, 0) / max(1, count.get(0, 0)) or 1.0
    net = fit(sample(docs, usable, "quality", per_label), min(max(odds, 0.01), 100.0))
    release()  # of the driver: the sample and the steps of the fit
    return net


def _score(net: Network | None, column: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = texts_of(batch.column(column))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score_texts(net, raw, offsets))], names=["doc_id", "held_out", "score"])

    return run


def classify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of doc_id, text."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", held_out().alias("held_out"), docs["text"].cast("string").alias("text"))
    scored = rows.mapInArrow(tidy(_score(net, 2)), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows whose text the network accepts, with all their columns; without a network, all rows."""
    if net is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = texts_of(batch.column(at))
            yield batch.filter(pa.array(score_texts(net, raw, offsets) >= THRESHOLD))

    at = docs.columns.index("text")
    return docs.mapInArrow(tidy(run), docs.schema)
