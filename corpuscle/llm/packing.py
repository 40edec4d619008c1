"""Packing in space-filling-curve order: neighbours along a Hilbert curve of projected document vectors share sequences.

A document's vector counts its hashed byte 4-grams over the whole text (square roots, length 1). Seeded random signs project
it to 4 dimensions, the normal distribution function spreads each over 10 bits, and the Hilbert key of that cell orders the
documents. They are dealt to ranges of the key (equal keys are split by a hash of doc_id), sorted, tokenized, closed with the
end id, and laid end to end; every 1024 ids are a sequence. What is left at a range's end is cut at the powers of two of its
length, so that it needs no padding either: a sequence has 1024 ids or a power of two.

Scale: one shuffle of the texts. Borders of the ranges come from the keys of a small sample of the documents (SAMPLE; they
only balance the load: any borders give a right packing). A range is packed as a stream: one Arrow batch and one open
sequence in memory. The vocabulary travels as a broadcast of a megabyte. A retried task gives the same pieces.

Null text: empty, one piece with the end id. Equal rows are packed each. Null doc_id: kept. Tables without rows give no rows.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import place_among, slices, texts_of, tidy

LENGTH, END_ID = 1024, 0
DIMENSIONS, CELL_BITS, VECTOR_BITS = 4, 10, 10
SAMPLE, UNIT = 0.02, 2048
PIECE = 1 << 18
#: Text in a range, about, as far as it takes no more than FINER times the shuffle's usual partitions; ids in a batch of pieces.
RANGE_BYTES, FINER, BATCH_IDS = 8 << 20, 4, 1 << 18


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer(ranks: bytes) -> object:
    """The byte-level BPE of a file of ranks: the ids of the public tokenizer with the same vocabulary."""
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of rows of integer coordinates below 2^bits."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(n):
            turn = (x[i] & q) != 0
            swap = np.where(turn, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turn, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        carry ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= carry
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key


def _signs(seed: int = 41) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (1 << VECTOR_BITS, DIMENSIONS))


_SIGNS = _signs()
_PHI = np.vectorize(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))), otypes=[float])


def curve_keys(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert keys of texts."""
    n = len(offsets) - 1
    cells = np.zeros((n, DIMENSIONS), np.int64)
    for i in range(n):
        counts = np.zeros(1 << VECTOR_BITS)
        for at in range(int(offsets[i]), int(offsets[i + 1]), PIECE):
            part = raw[at : min(int(offsets[i + 1]), at + PIECE + 3)].astype(np.uint32)
            if len(part) < 4:
                part = np.append(part, np.zeros(4 - len(part), np.uint32))
            gram = part[:-3] | (part[1:-2] << np.uint32(8)) | (part[2:-1] << np.uint32(16)) | (part[3:] << np.uint32(24))
            counts += np.bincount((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - VECTOR_BITS), minlength=1 << VECTOR_BITS)
        vector = np.sqrt(counts)
        size = np.sqrt(counts.sum())
        spread = _PHI(vector @ _SIGNS / size) if size else np.full(DIMENSIONS, 0.5)
        cells[i] = np.minimum((spread * (1 << CELL_BITS)).astype(np.int64), (1 << CELL_BITS) - 1)
    return hilbert_keys(cells, CELL_BITS).astype(np.int64)


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = texts_of(batch.column(1))
        keys = [curve_keys(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, 1 << 20)]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(key)], names=["doc_id", "text", "tie", "curve"])


def cut(rest: int) -> list[int]:
    """Lengths, powers of two and falling, that sum to ``rest``."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class _Packer:
    """Lays documents end to end; pieces come out once their sequence is full, or at the end."""

    def __init__(self, where: int) -> None:
        self.first, self.made = where << 32, 0
        self.open: list[tuple] = []  # pieces of the open sequence: doc_id, start, ids, doc_tokens
        self.filled = 0

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            part = ids[at : at + LENGTH - self.filled]
            self.open.append((doc_id, at, part, len(ids)))
            self.filled += len(part)
            at += len(part)
            if self.filled == LENGTH:
                yield from self.close(LENGTH)

    def close(self, length: int) -> Iterator[tuple]:
        """The open pieces' first ``length`` ids as a sequence."""
        offset, rest = 0, []
        for doc_id, start, ids, total in self.open:
            take = min(len(ids), length - offset)
            if take:
                yield doc_id, start, ids[:take].tobytes(), total, self.first + self.made, offset
            if take < len(ids):
                rest.append((doc_id, start + take, ids[take:], total))
            offset += take
        self.open, self.filled, self.made = rest, self.filled - length, self.made + 1

    def end(self) -> Iterator[tuple]:
        for length in cut(self.filled):
            yield from self.close(length)


@functools.lru_cache(1)
def _coder(ranks: bytes) -> object:
    """The tokenizer of a worker process, made once."""
    return tokenizer(ranks)


_NAMES = ("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset")


def _pack(ranks: object, kind: pa.DataType) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks.value)
        kinds = (kind, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)

        packer, out, size = None, [], 0
        for batch in batches:
            for doc_id, text, where in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if packer is None or packer.first != where << 32:
                    out += packer.end() if packer else ()
                    packer = _Packer(where)
                ids = np.array([*coder.encode(text.as_py(), allowed_special="all"), END_ID], "<u4")
                out += packer.add(doc_id, ids)
                size += len(ids)
                if size > BATCH_IDS:
                    if out:
                        yield table(out)
                    out, size = [], 0
        out += packer.end() if packer else ()
        if out:
            yield table(out)

    return run


def pack(docs: DataFrame, ranks_path: str | None = None, ranges: int | None = None) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit, binary), doc_tokens, sequence_id, offset: the pieces of all rows of doc_id, text."""
    spark = docs.sparkSession
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    with open(ranks_path or default_ranks(), "rb") as file:  # on the driver; tasks get the bytes
        ranks = spark.sparkContext.broadcast(file.read())
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 22) - 1))).alias("tie"))

    def keyed(some: DataFrame) -> DataFrame:
        curve = some.mapInArrow(tidy(_with_keys), f"doc_id {kind}, text string, tie bigint, curve bigint")
        return curve.withColumn("place", F.shiftleft("curve", 22) + F.col("tie"))

    chance = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(10_000))
    units = F.sequence(F.lit(0), F.floor(F.octet_length("text") / UNIT).cast("int"))  # a document counts by its size
    some = rows.where(chance < int(SAMPLE * 10_000))
    if ranges is None:  # up to FINER times as many, so that a range has about RANGE_BYTES of text
        size = (some.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / SAMPLE
        n = max(n, min(FINER * n, int(size / RANGE_BYTES)))
    borders = keyed(some).select("place", F.explode(units)) if n > 1 else None
    cuts = borders.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 10 * n + 1000)).first()[0] if borders is not None else None
    cuts = sorted({*(cuts or [])})
    where = place_among(cuts, F.col("place"))
    dealt = keyed(rows).select("doc_id", "text", "place", where.alias("range"))
    placed = dealt.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "place", "doc_id", "text")
    schema = f"doc_id {kind}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return placed.select("doc_id", "text", "range").mapInArrow(tidy(_pack(ranks, _arrow_type(docs))), schema)


def _arrow_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)
