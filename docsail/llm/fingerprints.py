"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every word n-gram is hashed once; the hash's top bits name one of BINS bins and the least remaining value in a bin is its
min-hash. An empty bin borrows from a bin chosen by a universal hash of (bin, attempt), the same for every document, until it
meets a filled one, which keeps collisions independent of how many bins are empty. BITS low-order bits of each bin are stored;
the estimator removes the share of matches that are due to chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsail.llm.shingles import grams, lower
from docsail.llm.textblocks import blocks, mix64

BINS = 256
BITS = 4
GRAM = 3
_LOG = BINS.bit_length() - 1


def binned(value: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, BINS): the least 32-bit value of the n-grams in each bin, and which bins have any."""
    docs = len(off) - 1
    doc = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(off))
    joint = np.sort(doc << np.uint64(32 + _LOG) | value >> np.uint64(64 - 32 - _LOG))
    place = (joint >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[np.ones(min(1, len(place)), bool), place[1:] != place[:-1]])
    low, filled = np.zeros(docs * BINS, np.uint32), np.zeros(docs * BINS, bool)
    low[place[first]], filled[place[first]] = joint[first].astype(np.uint32), True
    return low.reshape(docs, BINS), filled.reshape(docs, BINS)


def densified(low: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Every empty bin gets the value of the first filled bin on its own probe sequence; rows without any filled bin stay 0."""
    out = low.copy()
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        probe = (mix64(col.astype(np.uint64) + np.uint64(attempt * BINS)) % np.uint64(BINS)).astype(np.int64)
        found = filled[row, probe]
        out[row[found], col[found]] = low[row[found], probe[found]]
        row, col = row[~found], col[~found]
    return out


def packed(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(documents, BINS * bits / 8) bytes of the low-order bits, most significant first."""
    planes = (values[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.reshape(len(values), -1).astype(np.uint8), axis=1)


def fingerprints(column: pa.Array, n: int = GRAM, bits: int = BITS) -> pa.StructArray:
    """struct(fingerprint, filled_bins) of every text; null for a null text or one without words."""
    prints: list[bytes | None] = [None] * len(column)
    count: list[int | None] = [None] * len(column)
    for first, _, data, off, _ in blocks(lower(column), 1 << 18):
        value, at = grams(data, off, n)
        low, filled = binned(value, at)
        bins = filled.sum(axis=1)
        raw = packed(densified(low, filled), bits)
        for i in np.flatnonzero(bins):
            prints[first + i], count[first + i] = raw[i].tobytes(), int(bins[i])
    return pa.StructArray.from_arrays([pa.array(prints, pa.binary()), pa.array(count, pa.int32())], ["fingerprint", "filled_bins"])


def similarity(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Jaccard estimate from two fingerprints: equal bins less the 2 ** -bits that agree by chance, at least 0."""
    x, y = (np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, bits) for raw in (a, b))
    match, chance = (x == y).all(axis=1).mean(), 2.0**-bits
    return float(max(0.0, (match - chance) / (1 - chance)))


def similarity_column(a: str | Column, b: str | Column, bits: int = BITS) -> Column:
    """similarity() of two fingerprint columns; null where either is null."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([None if p is None or q is None else similarity(p, q, bits) for p, q in pairs], pa.float64())

    return run(a, b)


def fingerprint_documents(docs: DataFrame, n: int = GRAM, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, filled_bins) for every row of docs, in one pass without a shuffle.

    Null texts and texts without words have a null fingerprint; texts of fewer than n words count as one n-gram. Null ids and
    repeated rows pass through; an empty table gives an empty result; further columns are ignored.
    """

    @F.arrow_udf("fingerprint binary, filled_bins int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield fingerprints(batch, n, bits)

    return docs.select("doc_id", run("text").alias("p")).select("doc_id", "p.fingerprint", "p.filled_bins")
