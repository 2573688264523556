"""Arrow string columns as flat numpy byte blocks, so that kernels run over whole texts without Python strings."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1 rows, valid) of a string or binary column; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    valid = np.asarray(pc.is_valid(column).to_numpy(zero_copy_only=False), dtype=bool)
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(filled)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, offsets, data = filled.buffers()
    off = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0], valid


def blocks(column: pa.Array, max_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0, valid) of runs of rows with about max_bytes; a longer row is a run alone."""
    data, off, valid = utf8_buffers(column)
    first, n = 0, len(off) - 1
    while first < n:
        end = int(np.searchsorted(off, off[first] + max_bytes, side="right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[off[first] : off[end]], off[first : end + 1] - off[first], valid[first:end]
        first = end


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def release() -> None:
    """Gives a task's freed memory back to the system, since a Python worker is kept for later tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
