"""SimHash near duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each padded to a word of the binary Golay code of 23 bits, in which every word lies
within three bits of exactly one codeword. A segment's code is the 12-bit index of that codeword; its near codes are those
of the word and of all words one bit away in the segment, one or six of them. If two words differ by one bit at most, the
code of each is a near code of the other. Of three segments with three differing bits or fewer together, two segments differ by one
bit each at most. So for each of the three pairs of segments a fingerprint posts (near code, code) on one side and (code, near
code) on the other, up to 36 keys of 24 bits, and fingerprints that link meet at a key. What meets is verified on all 64 bits.

Equal fingerprints form a class, posted once. A dense group of classes is never expanded into its pairs: the classes at
a key are compared with the smallest one there, components of these links are found, and then classes at a key meet only
across components, each pair of components counting once. The comparison itself is an expression inside the join.

Null or empty texts and texts without a word have fingerprint zero, which links like any other. Repeated doc_ids are separate
rows. A component's id is its smallest doc_id, null if all are null. Tables without rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpoint, tidy
from .components import components

SEED, BITS = 42, 3
#: Bits of the segments, from the highest; each is a shortened word of the code.
SEGMENTS = (22, 21, 21)
LENGTH, DATA = 23, 12
#: Fixed value: the code's generator polynomial.
GENERATOR = 0xC75
PAIRS = ((0, 1), (0, 2), (1, 2))
PIECE = 1 << 20
#: Shingles hashed and counted at a time.
BLOCK = 1 << 14
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, LENGTH - DATA - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - (LENGTH - DATA))
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the words by their high and low bits, and the error pattern of every remainder."""
    single = [_remainder(1 << i) for i in range(LENGTH)]
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for i, r in enumerate(single):
        table, bit = (low, i) if i < 12 else (high, i - 12)
        table[np.flatnonzero(np.arange(len(table)) >> bit & 1)] ^= r
    errors = np.zeros(1 << (LENGTH - DATA), np.int32)
    for weight in range(4):
        for places in itertools.combinations(range(LENGTH), weight):
            errors[functools.reduce(operator.xor, (single[p] for p in places), 0)] = sum(1 << p for p in places)
    return high, low, errors


_HIGH, _LOW, _ERRORS = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """The index of the codeword nearest to each word of 23 bits."""
    return (words ^ _ERRORS[_HIGH[words >> 12] ^ _LOW[words & 0xFFF]]) >> (LENGTH - DATA)


def segment_codes(fingerprints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment: the code of every fingerprint (n), and the codes of its word and its neighbours (n x 1 + bits)."""
    out, left = [], 64
    for size in SEGMENTS:
        left -= size
        words = ((fingerprints >> np.uint64(left)) & np.uint64((1 << size) - 1)).astype(np.int32) << (LENGTH - size)
        flips = np.array([0, *(1 << b for b in range(LENGTH - size, LENGTH))], np.int32)
        near = decode(words[:, None] ^ flips[None])
        out.append((near[:, 0], near))
    return out


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time, so that a long text is never held as a list of words."""
    at = 0
    while at < len(raw):
        end = _SPACE.search(raw, at + PIECE) if at + PIECE < len(raw) else None
        stop = end.start() if end else len(raw)
        yield raw[at:stop].split()
        at = stop


def fingerprint(text: str, n: int = 3) -> int:
    """The SimHash of all n-word shingles of a text: a bit is 1 if it is in more than half of their hashes."""
    ones, total, carry = np.zeros(64, np.int64), 0, []
    counted = False
    for piece in _pieces(text.encode("utf-8", "surrogatepass").lower()):  # of bytes, so that only A to Z change
        words = carry + piece
        shingles = map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))
        while block := [xxh64_intdigest(s, SEED) for s in itertools.islice(shingles, BLOCK)]:
            ones += np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(block)
            counted = True
        carry = words[-(n - 1) :] if n > 1 else []
    if not counted:
        return xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in batches:
            values = np.array([fingerprint(t, n) if (t := s.as_py()) else 0 for s in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "print": pa.array(values), "task": pa.array([task] * len(values), pa.int32())})

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(print, left, right): the keys that a fingerprint posts on either side."""
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        codes = segment_codes(prints.view(np.uint64))
        near = [[sorted(set(row)) for row in n.tolist()] for _, n in codes]
        code = [c.tolist() for c, _ in codes]
        left = [[k << 24 | x << 12 | code[b][i] for k, (a, b) in enumerate(PAIRS) for x in near[a][i]] for i in range(len(prints))]
        right = [[k << 24 | code[a][i] << 12 | x for k, (a, b) in enumerate(PAIRS) for x in near[b][i]] for i in range(len(prints))]
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_pydict({"print": batch.column(0), "left": pa.array(left, kind), "right": pa.array(right, kind)})


def _alike(one: Column, other: Column, bits: int) -> Column:
    return F.bit_count(one.bitwiseXOR(other)) <= bits


def simhash_groups(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, print (the 64-bit fingerprint), component_id for every row of doc_id, text. Fingerprints of BITS or fewer differing bits link."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = checkpoint(texts.mapInArrow(tidy(_fingerprints(n)), "doc_id bigint, print bigint, task int"))
    # named by its smallest doc_id first, so that a component's smallest name tells its smallest doc_id
    name = F.struct(F.col("first").isNull().alias("unnamed"), "first", "print")
    classes = checkpoint(rows.groupBy("print").agg(F.min("doc_id").alias("first")).withColumn("name", name))
    keys = checkpoint(classes.select("print").mapInArrow(tidy(_keys), "print bigint, left array<int>, right array<int>"))
    left, right = (keys.select("print", F.explode(side).alias("key")) for side in ("left", "right"))

    # first round: the classes at a key against the smallest one
    pivots = left.groupBy("key").agg(F.min("print").alias("pivot"))
    met = right.join(pivots, "key").where((F.col("pivot") != F.col("print")) & _alike(F.col("pivot"), F.col("print"), BITS))
    links = _named(met.select(F.col("pivot").alias("a"), F.col("print").alias("b")).distinct(), classes)
    roots = checkpoint(components(links))
    # second round: across components; every pair of them once
    part = roots.select(F.col("node.print").alias("print"), F.col("root.print").alias("of"))
    left, right = (checkpoint(keys.select("print", side).join(part, "print", "left").withColumn("of", F.coalesce("of", "print"))).select("print", "of", F.explode(side).alias("key")) for side in ("left", "right"))
    meet = (F.col("l.key") == F.col("r.key")) & (F.col("l.of") != F.col("r.of")) & (F.col("l.print") < F.col("r.print")) & _alike(F.col("l.print"), F.col("r.print"), BITS)
    across = left.alias("l").join(right.alias("r"), meet).select(F.least("l.of", "r.of").alias("a"), F.greatest("l.of", "r.of").alias("b")).distinct()
    more = components(_named(across, classes))
    later = more.select(F.col("node").alias("root"), F.col("root").alias("last"))
    known = roots.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    alone = later.select(F.col("root").alias("node"), F.col("last").alias("root")).join(known.select("node"), "node", "left_anti")
    reached = known.unionAll(alone).select(F.col("node.print").alias("print"), F.col("root.first").alias("reached"), F.lit(True).alias("linked"))
    own = classes.join(reached, "print", "left").select("print", F.when(F.col("linked"), F.col("reached")).otherwise(F.col("first")).alias("component_id"))
    # a class meets each task that read it once, and the task's rows by both, so that its copies are spread
    own = rows.select("print", "task").distinct().join(own, "print")
    return rows.join(own, ["print", "task"]).select("doc_id", "print", "component_id")


def _named(links: DataFrame, classes: DataFrame) -> DataFrame:
    """The links (a, b) between fingerprints as links between the classes' names."""
    for end in ("a", "b"):
        links = links.join(classes.select(F.col("print").alias(end), F.col("name").alias(f"_{end}")), end)
    return links.select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def digests(docs: DataFrame) -> DataFrame:
    """The groups with their fingerprint as 16 hexadecimal digits."""
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
