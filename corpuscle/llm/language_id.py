"""Language identification by error-correcting output codes over byte n-grams.

Each language gets a codeword: for up to 5 languages all distinct bipartitions (the exhaustive code), for more a seeded
random code with the largest least distance found. One binary classifier per bit, a logistic regression over hashed byte
bigrams to 4-grams, predicts that bit. A text's margins are decoded by loss: the language whose codeword has the least sum
of log(1 + exp(-bit * margin)), each bit weighted by its accuracy on the training sample. Where the second language's loss
is close, the text is flagged as ambiguous.

Training: at most 400 documents of each language (a parameter), whole, never held-out
ones. Prediction reads the whole text and nothing else: a text's n-grams are summed up piece by piece, so memory is bounded
by a piece and not by the text.

Scale: one scan for the ids of the sample, one for its texts, one to predict; nothing is shuffled but sampled ids. The model
is 2^13 weights a bit and travels with the tasks.

Null text or text without a letter: ``und``, score 0. No language in the training rows: ``und`` for all. Equal texts get equal
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of, tidy
from .learning import held_out, logistic, sample

BITS = 13
PIECE = 1 << 18
#: Fixed rule of the ambiguity flag: the winner's share of exp(-loss) against the second language's is under this.
CLEAR = 0.75
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages by bits, -1 or 1
    weights: np.ndarray  # features by bits
    bias: np.ndarray
    trust: np.ndarray


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of -1 and 1 whose columns are distinct bipartitions."""
    if n <= 2:
        return np.array([[1], [-1]], np.int8)[:n]
    if n <= 5:
        return np.array([[1 if i == 0 or not (c >> (i - 1)) & 1 else -1 for c in range(1, 1 << (n - 1))] for i in range(n)], np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if least > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, least
    return best


def ngram_ids(raw: np.ndarray) -> np.ndarray:
    """Hashed ids of the byte 2-, 3- and 4-grams that begin at each place, lower-cased in A-Z; three rows."""
    x = np.concatenate([_LOWER[raw], np.full(3, 32, np.uint32)])
    n = len(raw)
    two = x[:n] | (x[1 : n + 1] << np.uint32(8))
    three = two | (x[2 : n + 2] << np.uint32(16))
    four = three | (x[3 : n + 3] << np.uint32(24))
    out = np.empty((3, n), np.uint32)
    for row, (value, factor) in enumerate(((two, 0x9E3779B1), (three, 0x85EBCA6B), (four, 0xC2B2AE35))):
        out[row] = (value * np.uint32(factor)) >> np.uint32(32 - BITS)
    return out


def _counts(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.bincount(ngram_ids(raw).ravel(), minlength=1 << BITS) / max(1, len(raw))


def train(docs: DataFrame, per_label: int = 400) -> Model | None:
    """A model from rows of doc_id, text, lang; None where nothing is labelled."""
    return fit(sample(docs, docs.select("doc_id", "lang"), "lang", per_label))


def fit(rows: pd.DataFrame) -> Model | None:
    rows = rows[rows["text"].str.len() > 0] if len(rows) else rows
    if not len(rows):
        return None
    languages = sorted(set(rows["lang"]))
    x = np.array([_counts(t) for t in rows["text"]], np.float32)
    x = np.sqrt(x)
    if len(languages) == 1:
        return Model(languages, np.ones((1, 1), np.int8), np.zeros((x.shape[1], 1), np.float32), np.ones(1), np.ones(1))
    place = rows["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()
    size = np.bincount(place, minlength=len(languages))
    even = 1.0 / size[place]
    code = codewords(len(languages))
    used = np.flatnonzero(x.any(0))
    few = x[:, used]
    weights = np.zeros((x.shape[1], code.shape[1]), np.float32)
    y = code[place] > 0
    weights[used], bias = logistic(few, y, even, l2=1e-4, steps=60, rate=0.1)
    right = ((few @ weights[used] + bias > 0) == y) * even[:, None]
    trust = np.maximum(1e-3, 2 * right.sum(0) / even.sum() - 1)
    return Model(languages, code, weights, bias, trust / trust.sum())


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the nearest codeword, score in 0 to 1, ambiguity, for rows of margins."""
    loss = np.logaddexp(0, -model.code[None] * margins[:, None, :]) @ model.trust
    share = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    score = share.max(1) / share.sum(1)
    ordered = np.sort(share, 1)
    clear = ordered[:, -1] / (ordered[:, -1] + ordered[:, -2]) if share.shape[1] > 1 else np.ones(len(share))
    return loss.argmin(1), score, clear < CLEAR


def _margins(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Margins of each text; features are square roots of n-gram rates over the whole text."""
    out = np.zeros((len(offsets) - 1, len(model.bias)))
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        counts = np.zeros(1 << BITS)
        for at in range(a, b, PIECE):
            stop = min(b, at + PIECE)
            ids = ngram_ids(raw[at : min(b, stop + 3)])[:, : stop - at]
            counts += np.bincount(ids.ravel(), minlength=1 << BITS)
        used = np.flatnonzero(counts)
        out[i] = np.sqrt(counts[used] / max(1, b - a)).astype(np.float32) @ model.weights[used] + model.bias
    return out


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(model: Model | None) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = texts_of(batch.column(1))
            lettered = np.array([_has_letter(t.as_py()) for t in batch.column(1)], bool)
            n = len(lettered)
            names, scores, doubt = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            if model is not None and n:
                for i, j in slices(offsets, PIECE):
                    place, score, unsure = decode(model, _margins(model, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                    names[i:j], scores[i:j], doubt[i:j] = np.array(model.languages, object)[place], score, unsure
                names[~lettered], scores[~lettered], doubt[~lettered] = "und", 0.0, False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores), pa.array(doubt)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, model: Model | None = None, per_label: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row of doc_id, text, lang."""
    model = model or train(docs, per_label)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(tidy(predict(model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
