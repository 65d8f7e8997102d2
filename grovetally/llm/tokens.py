"""Whole Arrow batches of text as numpy arrays of hashed words.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, after lower-casing
A-Z, which is what ``[^\\x20\\x09-\\x0D]+`` finds in the text.  A null text has no
words.  Nothing is cut: texts of any length are hashed in pieces that end at
white space, so working memory follows the longest word, not the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII byte that is neither a letter nor a digit, for words without punctuation.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, on an array it may overwrite."""
    h = h.astype(np.uint64, copy=False)
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of each."""
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        size = max(n + 1, PIECE + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[ends[0] : ends[-1]], ends - ends[0]


def trim() -> None:
    """Gives free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if trimmed := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trimmed(0)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; after the last one the worker, which lives on idle, gives its free memory back."""
    yield from batches
    trim()


def slices(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, pa.Array]]:
    """First row and rows of consecutive parts of a column, each of at most ``most`` bytes or one row."""
    _, offsets = buffers(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, column.slice(first, last - first)
        first = last


class Words:
    """The words of a batch: hash, start and end in ``data``, and first word of each row."""

    def __init__(self, column: pa.Array, stems: tuple[int, ...] = (), separators: np.ndarray = SPACE):
        raw, self.offsets = buffers(column)
        self.data = LOWER[raw]
        space = separators[self.data]
        n = len(self.data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        begins, finishes = ~space, ~space
        begins[1:] &= space[:-1] | edge[1:n]
        finishes[:-1] &= space[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash, self.stems = self._hashes(stems)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.count)

    def _hashes(self, stems: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
        out = np.empty(len(self.start), dtype=np.uint64)
        heads = [np.empty(len(self.start), dtype=np.uint64) for _ in stems]
        lo = 0
        while lo < len(self.start):
            origin = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, origin + PIECE, "right")))
            begin, end = self.start[lo:hi] - origin, self.end[lo:hi] - origin
            up, down = _powers(int(end[-1]))
            sums = np.zeros(int(end[-1]) + 1, dtype=np.uint64)
            np.cumsum((self.data[origin : origin + end[-1]].astype(np.uint64) + np.uint64(1)) * up[: end[-1]], out=sums[1:])
            length = (end - begin).astype(np.uint64)
            out[lo:hi] = mix((sums[end] - sums[begin]) * down[begin] + length)
            for stem, head in zip(stems, heads):
                cut = np.minimum(begin + stem, end)
                head[lo:hi] = mix((sums[cut] - sums[begin]) * down[begin] + np.uint64(0x51ED27 + stem))
            lo = hi
        return out, heads

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()
