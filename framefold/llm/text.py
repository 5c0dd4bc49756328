"""Words of Arrow string columns as numpy arrays: no Python object for each word.

A word is a run of bytes other than space and \\t..\\r, so it is the same run
of characters that [^\\x20\\x09-\\x0D]+ matches.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, unless one text is longer: their arrays fit a processor's cache.
SLICE_BYTES = 1 << 18
ODD = 0x9E3779B97F4A7C15
#: The C library's own, where it has one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse mod 2**64, as long as was needed so far."""

    def __init__(self) -> None:
        self.base, self.inverse = ODD, pow(ODD, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up[:n], self.down[:n]


POWERS = Powers()
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


@dataclass
class Words:
    """Of a run of texts: their bytes, where words start and end, and each text's first word (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order. Long texts are taken in blocks, to bound memory."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 20), "right")))
        low = starts[at]
        block = data[low : ends[to - 1]]
        up, down = POWERS.upto(len(block) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[block] * up[: len(block)], out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[b] - sums[a]) * down[a])
        at = to
    return out


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to, bytes, offsets) of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lower_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """slices() in lower case; one slice at a time is copied."""
    for at, to, _, _ in slices(column, limit):
        for _, _, data, offsets in slices(pc.utf8_lower(column.slice(at, to - at)), 1 << 62):
            yield at, to, data, offsets


def release() -> None:
    """Give freed memory back to the system, as a worker that waits for its next task keeps it else."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    if lower:
        data = LOWER[data]
    ink = ~IS_SPACE[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= ink[inner]
    ends[inner - 1] |= ink[inner - 1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets), offsets)


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbours in values."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(values) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(ODD) + values[k : len(values) - n + 1 + k]
    return mix(out)
