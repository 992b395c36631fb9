"""Vectorised words, shingles and hashes over Arrow string columns.

A word is a maximal run of bytes above 0x20; every text is read whole.  Texts are taken in slices of about
``SLICE`` bytes, so memory follows the longest single text and not the batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_SPAN = 1 << 16
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POW = np.cumprod(np.full(_SPAN, 0xD1342543DE82EF95, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (2.0**-53)


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that gives its freed memory back at the end.

    Spark keeps Python workers for later tasks; without this each would hold the peak of every stage it has served.
    """

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def strings(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> pa.Array:
    """The column as one string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.utf8_lower(column) if lower else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and its offsets from 0."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``size`` bytes; a longer text stands alone."""
    _, off = buffers(column)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + size, "right")) - 1)
        yield first, column.slice(first, min(last, n) - first)
        first = min(last, n)


@dataclass
class Words:
    raw: np.ndarray  #: bytes of all texts
    offsets: np.ndarray  #: byte offsets of the texts
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    doc: np.ndarray  #: text of each word
    first: np.ndarray  #: first word of each text, and the number of words
    hash: np.ndarray  #: 64-bit hash of each word

    def points(self) -> np.ndarray:
        """Code points before each byte, and in all."""
        return np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])


def words(column: pa.Array) -> Words:
    """Split and hash the words of every text of ``column`` (from :func:`strings`)."""
    raw, off = buffers(column)
    inside = raw > 32
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(column)), np.diff(first))
    if not len(start):
        return Words(raw, off, start, end, doc, first, np.zeros(0, np.uint64))
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    with np.errstate(over="ignore"):
        each = _BYTE[raw[inside]] * _POW[place & (_SPAN - 1)]
        hashed = mix(np.add.reduceat(each, at) + size.astype(np.uint64) * _MUL)
    return Words(raw, off, start, end, doc, first, hashed)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every run of ``k`` words; a text of 1 to k-1 words is one run of all of them."""
    n = len(w.hash)
    with np.errstate(over="ignore"):
        length = np.diff(w.first)
        count = np.where(length >= k, length - k + 1, np.minimum(length, 1))
        doc = np.repeat(np.arange(len(length)), count)
        at = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
        place = np.arange(int(count.sum())) - np.repeat(at, count) + np.repeat(w.first[:-1], count)
        total = np.zeros(len(place), np.uint64)
        stop = w.first[1:][doc] if len(doc) else place
        for j in range(k):
            here = place + j
            ok = here < stop
            total = total * _POW[1] + np.where(ok, w.hash[np.minimum(here, max(n - 1, 0))], np.uint64(0)) if n else total
        return mix(total), doc, place


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return at, np.diff(np.append(at, len(sorted_values)))
