"""Word shingles of whole texts as sets of 64-bit hashes, in numpy over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from .common import mix64

_U = np.uint64
#: The separators, space and the controls 9 to 13.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def _byte_table(lower: bool) -> np.ndarray:
    """A random 64-bit number for each byte; A to Z share those of a to z if ``lower``."""
    byte = np.arange(256)
    if lower:
        byte[65:91] += 32
    return mix64(byte.astype(np.uint64) + _U(0x51ED27))


_LOWER, _EXACT = _byte_table(True), _byte_table(False)
_BASE = 0xD6E8FEB86659FD93


class _Powers:
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


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 borders of the texts among them. raw: bytes of texts at ``offsets``."""
    n = len(raw)
    counts = np.zeros(len(offsets), np.int64)
    if not n:
        return np.zeros(0, np.uint64), counts
    inside = ~_SEPARATOR[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[filled] = inside[filled]  # a text's first word does not continue the text before
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _Powers.upto(n)
    sums = np.cumsum((_LOWER if lower else _EXACT)[raw] * up[:n])
    value = sums[last]
    value -= np.where(first > 0, sums[first - 1], _U(0))
    value *= down[first]
    return mix64(value ^ (last - first).astype(np.uint64)), np.searchsorted(first, offsets)


def shingle_hashes(words: np.ndarray, borders: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-word shingle at every place where one begins, and the borders of the texts among them.

    A text of fewer than n words has one shingle, all its words; a text without words has none.
    """
    total = len(words)
    size = np.diff(borders)
    value = np.zeros(total, np.uint64)
    for k in range(n):
        if k < total:
            value[: total - k] += mix64(words[k:] + _U((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1)))
    value = mix64(value)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    for i in np.flatnonzero((size > 0) & (size < n)):  # at most n - 1 words each
        part = words[borders[i] : borders[i + 1]]
        whole = np.zeros(1, np.uint64)
        for k in range(len(part)):
            whole += mix64(part[k : k + 1] + _U((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1)))
        value[borders[i]] = mix64(whole ^ _U(len(part)))[0]
    keep = np.arange(total) - np.repeat(borders[:-1], size) < np.repeat(count, size)
    return value[keep], np.append(0, np.cumsum(count))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    values, borders = shingle_hashes(*word_hashes(raw, offsets), n)
    return [np.unique(values[a:b]) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
