"""Arrow text columns as flat bytes, for operators that work on whole batches in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts worked on at once: small enough for the caches.
PIECE_BYTES = 1 << 18
UPPER_TO_LOWER = np.arange(256, dtype=np.uint8)
UPPER_TO_LOWER[65:91] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts without nulls; text k is bytes[offsets[k]:offsets[k + 1]]."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def pieces(column: pa.Array, cut: np.ndarray | None = None, size: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of runs of texts of about `size` bytes.

    A text that is longer comes whole, or in several pieces with its number if it may be cut after bytes (a table of 256).
    """
    data, at = flat(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        a, b, step = int(at[first]), int(at[last]), size
        while cut is not None and last == first + 1 and b - a > step:
            spots = np.flatnonzero(cut[data[a : a + step]])
            if len(spots):
                end = a + int(spots[-1]) + 1
                yield first, data[a:end], np.array([0, end - a])
                a, step = end, size
            else:
                step *= 2
        yield first, data[a:b], np.maximum(at[first : last + 1] - a, 0)
        first = last


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of bytes that are `inside`; none spans two texts."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1
