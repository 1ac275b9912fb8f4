"""Vectorised word and shingle hashing over Arrow string batches.

A word is a maximal run of code points outside ``[\\x20\\x09-\\x0D]``.  All of
those separators are single ASCII bytes, so words are cut on the UTF-8 buffer
of an Arrow string column without building one Python object per word.

Hashes are 64-bit polynomial fingerprints over GF(2**64)-free integer
arithmetic (wrap-around ``uint64``), each byte first sent through a fixed random
table and every result through a finaliser.  They are pure functions of the
word bytes, so every executor and every run agrees on them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
SEED_MIX = np.uint64(0x2545F4914F6CDD1D)


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 2**64))


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, _inverse(base)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inv)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(BASE), _Powers(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of the rows) of a string array; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return data[first:last], offsets - first


def slices(batches: Iterator[pa.RecordBatch], text_at: int, rows: int = 1000, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that no piece has more than ``rows`` rows, nor more bytes of text than ``size`` but for a single longer text."""
    for batch in batches:
        offsets = string_buffers(batch.column(text_at))[1]
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
            hi = min(max(lo + 1, hi), lo + rows, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: a worker waits for its next task while others share the executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data - np.uint8(9)) <= 4)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) - byte bounds of every word; ``first[i]`` is row i's first word, ``first[-1]`` the total."""
    inside = ~is_space(data)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[tails] = inside[tails]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, everything else untouched."""
    return data + ((data - np.uint8(65)) <= 25).astype(np.uint8) * np.uint8(32)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    up, down = _BYTES.get(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + SEED_MIX * (end - start).astype(np.uint64))


def span_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points."""
    up, down = _BYTES.get(len(points) + 1)
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + SEED_MIX) * up[: len(points)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + SEED_MIX * (end - start).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive entries (rows are not looked at)."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.get(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=prefix[1:])
    return mix((prefix[size:] - prefix[: n - size + 1]) * down[: n - size + 1])


def span_hash(words: np.ndarray) -> np.uint64:
    """The hash of a whole word sequence, equal to ``window_hashes`` of its length."""
    return window_hashes(words, len(words))[0]


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values, by doubling."""
    span, out = 1, values
    while span * 2 <= size:
        out = np.minimum(out[:-span], out[span:]) if len(out) > span else out[:0]
        span *= 2
    if span < size:
        extra = size - span
        out = np.minimum(out[:-extra], out[extra:]) if len(out) > extra else out[:0]
    return out
