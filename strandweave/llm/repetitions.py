"""Periodic runs of words: masking by repeated k-grams, then divide and conquer over what survives.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``least`` words and
``exponent`` periods long, that no neighbouring word extends.  In a run of L words the first L - q come again q words
later, so with k the least such overlap that a run can have, every word of a run lies in a k-gram that its document
repeats.  Words outside of such k-grams are masked; what is left falls into segments, mostly none.

In the segments runs are found as Main and Lorentz do: each run crosses exactly one midpoint of the dyadic division
that no larger block has, with at least half of its periods on one side; for every midpoint and period the longest
extensions to both sides give the run.  All midpoints of a level are worked on at once; extensions are read off prefix
hashes by bisection, and every run is compared word by word in the end (a clash of hashes falls back on comparing
whole segments).

Null text counts as empty.  The extra columns of a table pass unchanged; ``runs`` is replaced.  A single text is held
whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import buffers, mix, slices, strings, tidy

LEAST, EXPONENT = 6, 4
_BASE = 0xD1342543DE82EF95


def overlap(least: int, exponent: int) -> int:
    """The least number of words that come again one period later in any run."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of values times powers before each position, powers); hashes of equal stretches differ by a power."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(values), _BASE, np.uint64)]))
        return np.concatenate([[np.uint64(0)], np.cumsum(values * power[:-1], dtype=np.uint64)]), power


def survivors(ids: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that their document holds twice; ``first`` has the documents' first words and the end."""
    n = len(ids)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    at = np.flatnonzero(left >= k)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    value = mix(ids.astype(np.uint64) + np.uint64(1))
    key = mix(doc[at].astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    with np.errstate(over="ignore"):
        for j in range(k):
            key = key * np.uint64(_BASE) + value[at + j]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + k, -1)
    return np.cumsum(edge[:n]) > 0


def _longest(equal, limit: np.ndarray) -> np.ndarray:
    """The largest l <= limit with equal(l), where equal holds up to some length."""
    low, high = np.zeros_like(limit), limit.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        ok = equal(mid) & open_
        low, high = np.where(ok, mid, low), np.where(open_ & ~ok, mid - 1, high)
    return low


def runs_of(ids: np.ndarray, begin: np.ndarray, stop: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of ``ids``, inside segments that reach from begin[i] to stop[i] around word i."""
    n = len(ids)
    sums, power = _prefixes(mix(ids.astype(np.uint64) + np.uint64(1)))
    found = []

    def equal(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (sums[x + size] - sums[x]) * power[y - x] == sums[y + size] - sums[y]

    half = 1
    while half < n:
        m = np.arange(half, n, 2 * half)
        m = m[begin[m] < m]
        for right in (True, False):
            room = np.minimum(half, stop[m] - m if right else m - begin[m])
            most = room * 2 // exponent  # a run has half of its periods on one side
            mid = np.repeat(m, most)
            q = np.arange(len(mid)) - np.repeat(np.cumsum(most) - most, most) + 1
            need = (exponent * q + 1) // 2 - q
            if exponent > 2:  # the first pair of words on that side settles most
                ok = ids[mid] == ids[mid + q] if right else ids[mid - 1] == ids[mid - 1 - q]
                mid, q, need = mid[ok], q[ok], need[ok]
                x = mid if right else mid - q - need
                ok = equal(x, x + q, need)
                mid, q = mid[ok], q[ok]
            x = mid if right else mid - q
            forth = _longest(lambda l, x=x, q=q: equal(x, x + q, l), stop[mid] - x - q)
            back = _longest(lambda l, x=x, q=q: equal(x - l, x + q - l, l), x - begin[mid])
            start, end = x - back, x + q + forth
            ok = end - start >= np.maximum(least, exponent * q)
            found.append(np.stack([start[ok], end[ok], q[ok]], axis=1))
        half *= 2
    if not found or not (rows := np.concatenate(found)).size:
        return []
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])]  # the smallest period of a stretch
    for s, e, q in rows.tolist():
        if (ids[s : e - q] != ids[s + q : e]).any() or s > begin[s] and ids[s - 1] == ids[s - 1 + q] or e < stop[s] and ids[e] == ids[e - q]:
            return _plain(ids, begin, stop, least, exponent)
    return [tuple(x) for x in rows.tolist()]


def _plain(ids: np.ndarray, begin: np.ndarray, stop: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """The same by comparing every period of every segment."""
    out: dict[tuple[int, int], int] = {}
    for a in np.unique(begin).tolist():
        own = ids[a : stop[a]]
        for q in range(1, len(own) // exponent + 1):
            same = np.concatenate([[0], (own[q:] == own[:-q]).astype(np.int8), [0]])
            edge = np.diff(same)
            for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                if e - s + q >= max(least, exponent * q):
                    out.setdefault((a + s, a + e + q), q)
    return [(s, e, q) for (s, e), q in sorted(out.items())]


def runs_in(texts: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(first word, number of words, period) of the runs of each text, by first word and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    number: dict[bytes, int] = {}
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(first[-1]))
    kept = np.flatnonzero(survivors(ids, first, overlap(least, exponent)))
    if not len(kept):
        return out
    doc = np.searchsorted(first, kept, "right") - 1
    head = np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(doc) > 0)])
    edge = np.append(np.flatnonzero(head), len(kept))
    begin, stop = np.repeat(edge[:-1], np.diff(edge)), np.repeat(edge[1:], np.diff(edge))
    for s, e, q in runs_of(ids[kept], begin, stop, least, exponent):
        out[doc[s]].append((int(kept[s] - first[doc[s]]), e - s, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[k] for k in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_runs(documents: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``documents`` with ``text`` collapsed to its words outside of repeated periods, and all ``runs`` that were found.

    Words are what stands between blanks and the control characters 9 to 13; those kept are joined by one blank.
    ``runs`` has start and length in words of the text as it was, ordered by start and period.
    """
    rest = [f for f in documents.schema.fields if f.name.lower() not in ("text", "runs")]
    names = [*(f.name for f in rest), "text", "runs"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "text string, runs array<struct<start:bigint,length:bigint,period:bigint>>"])

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(strings(batch.column(len(rest)))):
                raw, offsets = buffers(part)
                data, edge = raw.tobytes(), offsets.tolist()
                texts = [data[a:b].split() for a, b in zip(edge, edge[1:], strict=False)]
                found = runs_in(texts, least, exponent)
                text = pa.array([collapsed(w, r) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found], pa.list_(_RUN))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(part)).columns[: len(rest)], text, runs], names)

    return documents.select(*[f"`{f.name}`" for f in rest], "text").mapInArrow(made, schema)
