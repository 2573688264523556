"""Hashed word n-grams of whole texts, by vectorised prefix sums over byte blocks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docsail.llm.textblocks import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PART = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, word offsets of the documents); words are runs of bytes that aren't ASCII white space."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    cut = off[1:-1][off[1:-1] < n]
    before = np.r_[False, inside[:-1]]
    before[cut] = False
    after = np.r_[inside[1:], False]
    after[cut[cut > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    value, first = np.empty(len(start), np.uint64), 0
    while first < len(start):  # some words at a time, as the sums take many times a text's memory
        base = start[first]
        last = max(first + 1, int(np.searchsorted(end, base + _PART, side="right")))
        part, a, b = data[base : end[last - 1]], start[first:last] - base, end[first:last] - base
        up, down = _powers(1 << max(10, len(part).bit_length()))
        with np.errstate(over="ignore"):
            total = np.r_[np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * up[: len(part)], dtype=np.uint64)]
            value[first:last] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
        first = last
    return mix64(value), np.searchsorted(start, off)


def grams(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word n-gram, gram offsets of the documents). A text of fewer than n words, but some, is one gram."""
    word, at = words(data, off)
    count = np.diff(at)
    many = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), many)
    first = at[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(count[doc], n)
    value = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            w = word[np.minimum(first + j, max(len(word) - 1, 0))] if len(word) else np.zeros(0, np.uint64)
            value = value * np.uint64(_BASE) + np.where(j < size, w, np.uint64(0))
    return mix64(value), np.r_[0, np.cumsum(many)].astype(np.int64)
