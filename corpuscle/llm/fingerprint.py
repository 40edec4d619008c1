"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases whose borders depend on a few neighbouring symbols only, and the phrases, named by hashes of
what they hold, are the symbols of the next level, up to one name for the whole text. On each level runs of one symbol
become one symbol; then deterministic coin tossing (each symbol is labelled by the lowest bit in which it differs from its
left neighbour, and by that bit's value, again and again until the labels are below 8) gives labels that differ between
neighbours (as far as the low 16 bits of their names differ), and a phrase starts at each local maximum of the labels. Equal substrings thus get equal phrases but for a few
symbols at their ends, wherever they stand.

A fingerprint is the name of the whole text and two bottom-k sketches of the bag of phrase names: of the levels from 3 up (about
thirty characters a phrase and more), and of levels 1 and 2. Two fingerprints' likeness is the mean of the Jaccard
similarities of the bags that the two pairs of sketches estimate, weighted by the n names that the sketches of the higher
levels hold together, and by FEW for the lower ones, which so count where higher names are few; 1 for equal texts.

Scale: a text's fingerprint needs that text alone. Pairing each document with the next one by doc_id takes one shuffle of the
texts into ranges of doc_id, whose borders come from approximate quantiles; the first document of each range is copied to
the range before, so ranges are independent of each other. The driver sees two numbers a range. Memory: one batch of
about a megabyte of text at a time; a longer text is handled alone.

Null text: empty. Null doc_id: before all others. Equal doc_ids: ordered by text. A single document is its own next one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, place_among, tidy

COARSE, FINE, FEW = 64, 16, 4
BATCH_CHARS = 1 << 17
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_U = np.uint64


def _place_table() -> np.ndarray:
    """Place of the lowest bit set in a 16-bit number, 0 for 0."""
    table = np.zeros(1 << 16, np.uint8)
    for bit in range(1, 16):
        table[1 << bit :: 1 << bit] = bit
    return table


def _label_table(size: int = 32) -> np.ndarray:
    """Label of a symbol under ``size`` after a left neighbour under ``size``, by neighbour * size + symbol."""
    left, own = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    place = _PLACE[left ^ own]
    return (2 * place + ((own >> place) & 1)).astype(np.uint8).ravel()


_PLACE = _place_table()
_LABEL = _label_table()
_BASE = 0x9E3779B97F4A7C15
_ROUNDS = 2  # labels below 32, then 10, then 8
_CHARS = mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))


class _Powers:
    """Powers of the base and of its inverse, as many as asked for so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 18)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers))
        return cls.up, cls.down


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels by coin tossing over the symbols' low 16 bits; ``first``: places where a text begins."""
    own = symbols.astype(np.uint16)
    differ = np.empty_like(own)
    np.bitwise_xor(own[1:], own[:-1], out=differ[1:])
    differ[first] = 1
    place = _PLACE[differ]
    label = (2 * place + ((own >> place) & 1)).astype(np.uint16)
    for _ in range(_ROUNDS):
        pair = label.copy()
        pair[1:] += label[:-1] << np.uint16(5)
        pair[first] = label[first] + (label[first] ^ 1) * 32
        label = _LABEL[pair].astype(np.uint16)
    return label


def _collapse(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol within a text become one symbol that names the run."""
    new = np.ones(len(symbols), bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[starts[:-1]] = True
    at = np.flatnonzero(new)
    if len(at) == len(symbols):
        return symbols, starts
    run = np.diff(np.append(at, len(symbols))).astype(np.uint64)
    out = symbols[at]
    long = run > 1
    out[long] = mix64(out[long] * _U(0x9FB21C651E98DF25) ^ mix64(run[long]))
    return out, np.searchsorted(at, starts)


def _phrases(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's symbols. starts: n + 1 borders of the texts, none of them empty."""
    label = _labels(symbols, starts[:-1])
    begins = np.zeros(len(symbols), bool)
    begins[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    begins[starts[1:] - 1] = False  # the last symbol has no right neighbour: it never opens a phrase
    begins[starts[:-1]] = True
    at = np.flatnonzero(begins)
    up, down = _Powers.upto(len(symbols) + 1)
    sums = np.cumsum(symbols * up[: len(symbols)])
    upto = np.append(sums[at[1:] - 1], sums[-1])
    name = upto.copy()
    name[1:] -= upto[:-1]
    name *= down[at]  # a phrase's hash does not depend on where it stands
    return mix64(name ^ mix64(np.diff(np.append(at, len(symbols))).astype(np.uint64))), np.searchsorted(at, starts)


def _bag(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted names of the first, second, ... occurrence of each phrase, so that sets of them compare as bags."""
    if not parts:
        return np.zeros(0, np.uint64)
    names = np.sort(np.concatenate(parts))
    place = np.arange(len(names))
    first = np.ones(len(names), bool)
    first[1:] = names[1:] != names[:-1]
    return np.sort(mix64(names + (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64) * _U(_BASE)))


def parse_texts(texts: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each text: the name of the whole, the bag of phrase names of the higher levels, and of the lower ones."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    ids = np.flatnonzero(size)
    root = [0] * len(texts)
    higher: list[list[np.ndarray]] = [[] for _ in texts]
    lower: list[list[np.ndarray]] = [[] for _ in texts]
    starts = np.append(0, np.cumsum(size[ids]))
    symbols, level = _CHARS[data & np.uint32(0xFFFF)], 0
    if len(data) and data.max() > 0xFFFF:
        symbols = np.where(data > 0xFFFF, mix64(data.astype(np.uint64) + _U(1)), symbols)
    while len(ids):
        symbols, starts = _collapse(symbols, starts)
        symbols, starts = _phrases(symbols, starts)
        level += 1
        size = np.diff(starts)
        kept = higher if level > 2 else lower
        for i, a, b in zip(ids.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            kept[i].append(symbols[a:b])
        done = size == 1
        for i, a in zip(ids[done].tolist(), starts[:-1][done].tolist(), strict=True):
            root[i] = int(mix64(symbols[a : a + 1] + _U(level))[0])
        if done.any():
            symbols = symbols[np.repeat(~done, size)]
            ids, size = ids[~done], size[~done]
            starts = np.append(0, np.cumsum(size))
    return [(root[i], _bag(higher[i]), _bag(lower[i])) for i in range(len(texts))]


def encode(parsed: tuple[int, np.ndarray, np.ndarray]) -> str:
    root, coarse, fine = parsed
    head = root.to_bytes(8, "big") + bytes([min(len(coarse), COARSE)])
    sketch = np.concatenate([coarse[:COARSE], fine[:FINE]]) >> _U(32)
    return base64.b64encode(head + sketch.astype(">u4").tobytes()).decode()


def fingerprints(texts: list[str]) -> list[str]:
    return [encode(p) for p in parse_texts(texts)]


def _split(fingerprint: str) -> tuple[bytes, list[int], list[int]]:
    raw = base64.b64decode(fingerprint)
    sketch = np.frombuffer(raw, ">u4", offset=9).tolist()
    return raw[:8], sketch[: raw[8]], sketch[raw[8] :]


def _jaccard(a: list[int], b: list[int], k: int) -> float:
    """Share of the k smallest of the union that lie in both."""
    x, y = set(a), set(b)
    least = sorted(x | y)[:k]
    both = x & y
    return sum(v in both for v in least) / len(least) if least else 0.0


def likeness(one: str, other: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if one == other:
        return 1.0
    (_, coarse1, fine1), (_, coarse2, fine2) = _split(one), _split(other)
    n = len(set(coarse1) | set(coarse2))
    return (n * _jaccard(coarse1, coarse2, COARSE) + FEW * _jaccard(fine1, fine2, FINE)) / (n + FEW)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first characters of the next text, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by range, helper rows last in their range; each document meets the row after it."""
    held: list[tuple[object, str, int]] = []  # documents read and not yet answered: id, text, range
    ready = 0

    def answer(rows: list, texts: list[str]) -> pd.DataFrame:
        n = len(rows)
        changed = [edited(texts[i], texts[i + 1]) for i in range(n)]
        prints = fingerprints([*texts, *changed])
        own, new = prints[: n + 1], prints[n + 1 :]
        return pd.DataFrame(
            {
                "doc_id": pd.array([r[0] for r in rows], "Int64"),
                "n_chars": [len(t) for t in texts[:n]],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                "fingerprint": own[:n],
                "edited_fingerprint": new,
                "near_edited": [likeness(own[i], new[i]) for i in range(n)],
                "near_next": [likeness(own[i], own[i + 1]) for i in range(n)],
            }
        )

    for batch in batches:
        for i, text, where, helper in zip(batch["doc_id"], batch["_text"], batch["_range"], batch["_helper"], strict=True):
            if helper:
                if held and held[-1][2] == where:  # the first helper closes the range; further ones find nothing held
                    yield answer(held, [*(h[1] for h in held), text])
                    held, ready = [], 0
                continue
            held.append((None if pd.isna(i) else int(i), text, where))
            ready += len(text)
            if ready >= BATCH_CHARS and len(held) > 1:
                yield answer(held[:-1], [h[1] for h in held])
                held = held[-1:]
                ready = len(held[0][1])
    assert not held, "a range has no row after its last document"


def fingerprint_documents(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and its edited text, for rows of doc_id, text; columns as in SCHEMA."""
    spark = docs.sparkSession
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("_key"))
    cuts = rows.agg(F.percentile_approx("_key", [i / n for i in range(1, n)] if n > 1 else [0.5], 10 * n + 1000)).first()[0]
    cuts = sorted({*cuts}) if cuts and n > 1 else []
    where = place_among(cuts, F.col("_key"))
    firsts = sorted((r["_range"], r["_first"]) for r in rows.groupBy(where.alias("_range")).agg(F.min("_key").alias("_first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # the first range follows the last
    copies = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.lit(None).cast("map<bigint,int>")
    own, helper = F.struct(where.alias("_range"), F.lit(False).alias("_helper")), F.try_element_at(copies, F.col("_key")).cast("int")
    both = F.array_compact(F.array(own, F.when(helper.isNotNull(), F.struct(helper.alias("_range"), F.lit(True).alias("_helper")))))
    dealt = rows.select("doc_id", "_text", "_key", F.explode(both).alias("_at")).select("doc_id", "_text", "_key", "_at.*")
    placed = dealt.repartitionById(max(1, len(cuts) + 1), F.col("_range")).sortWithinPartitions("_range", "_helper", "_key", "_text")
    return placed.select("doc_id", "_text", "_range", "_helper").mapInPandas(tidy(_pairs), SCHEMA)
