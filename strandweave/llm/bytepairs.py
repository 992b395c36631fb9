"""Byte-level BPE encoding and decoding with a vectorised pre-tokeniser.

A text is split as ``public_tokenizers.PATTERN`` splits it, without a regex: every code point gets a class (an array
over all code points, with what the next one or two decide folded in), every class is a transition function over the
eight states of the splitter, and since composing functions is associative, a blocked scan gives the state before
every code point of a whole slice of texts at once.  A piece begins where class and state say so.

The distinct pieces that a task sees are merged once and kept: all new short pieces advance together, each merging
its leftmost pair of lowest rank a round; long ones use a heap.  Every id keeps the byte offset of its token, and
decoding places each token's bytes there.

Null text counts as empty; an empty text has no ids.  Other columns pass unchanged; columns that are named as the
results are replaced.  A single text is held whole in one task, with about 20 bytes a code point.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import buffers, slices, strings, tidy
from .wordtable import WordTable

MOST_WORDS = 400_000
MOST_BYTES = 1 << 25
SLICE_IDS = 1 << 18
SHORT = 64
_SIZE = 1 << 18
_NONE = np.int64(1 << 40)

# Classes: letter, number, other, apostrophe before a contraction of one or two letters, white space that more or
# the end follows, a blank that leads the next piece, the last of other white space.
LETTER, NUMBER, OTHER, SHORT_FORM, LONG_FORM, SPACE, LEAD, LAST = range(8)
# States: within letters, numbers, others, white space; after a leading blank; between pieces; before the last or the
# last two letters of a contraction.
_WITHIN = {LETTER: 0, NUMBER: 1, OTHER: 2, SPACE: 3}
AFTER_LEAD, BETWEEN, ONE_LEFT, TWO_LEFT = 4, 5, 6, 7
#: The contractions of the pattern, by their letters.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
_IS_ONE = np.array([chr(c) in ONE_LETTER for c in range(128)])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _step(kind: int, state: int) -> tuple[int, bool]:
    """(state after a code point of class ``kind``, whether a piece begins with it)."""
    if kind == LETTER and state in (ONE_LEFT, TWO_LEFT):
        return (BETWEEN, False) if state == ONE_LEFT else (ONE_LEFT, False)
    if kind in (LEAD, LAST):
        return (AFTER_LEAD if kind == LEAD else BETWEEN), True
    run = _WITHIN[OTHER if kind in (SHORT_FORM, LONG_FORM) else kind]
    if state == run or state == AFTER_LEAD and kind != SPACE:
        return run, False
    return {SHORT_FORM: ONE_LEFT, LONG_FORM: TWO_LEFT}.get(kind, run), True


def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all compositions: (state after by code and state, code of one after another, whether a piece begins by class and state).

    Code k < 8 is class k, code 8 + k class k at the front of a text, whatever went before; 16 does nothing.
    """
    steps = [tuple(_step(k, s)[0] for s in range(8)) for k in range(8)]
    found = [*steps, *((f[BETWEEN],) * 8 for f in steps), tuple(range(8))]
    number = {f: k for k, f in reversed(list(enumerate(found)))}
    at = 0
    while at < len(found):  # closed under composition with the classes, hence under composition
        for g in found[:17]:
            h = tuple(g[s] for s in found[at])
            if h not in number:
                number[h] = len(found)
                found.append(h)
        at += 1
    then = np.array([[number[tuple(g[s] for s in f)] for g in found] for f in found])
    begins = np.array([[_step(k, s)[1] for s in range(8)] for k in range(8)])
    return np.array(found, np.uint8), then.astype(np.uint8), begins


STATE, THEN, BEGINS = _functions()
_NOTHING = 16


def scan(code: np.ndarray) -> np.ndarray:
    """The state after every position, from functions' codes: prefixes of rows side by side, then the rows' totals likewise."""
    n = len(code)
    if n <= 64:
        out, state = np.zeros(n, np.uint8), BETWEEN
        for k, f in enumerate(code.tolist()):
            out[k] = state = STATE[f, state]
        return out
    width = 1 << max(3, n.bit_length() // 2)
    rows = -(-n // width)
    grid = np.full(rows * width, _NOTHING, np.uint8)
    grid[:n] = code
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat, size = THEN.ravel(), np.uint16(len(THEN))
    for k in range(1, width):
        grid[k] = flat[grid[k - 1] * size + grid[k]]
    entering = np.concatenate([[np.uint8(BETWEEN)], scan(grid[-1])[:-1]])
    return STATE[grid, entering[None, :]].T.ravel()[:n]


@lru_cache(maxsize=1)
def code_points() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for every code point, by the Unicode tables of the ``tiktoken`` library itself."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(probe.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin in ``points``, the code points of texts of which each begins at one of ``first``."""
    n = len(points)
    kind = code_points()[points]
    front = np.zeros(n + 1, bool)
    front[first] = True
    ends = front[1:].copy()  # the last code point of a text
    if n:
        ends[-1] = True
    following = lambda x: np.where(ends, False, np.concatenate([x[1:], [False]])) if n else x
    is_space = kind == SPACE
    last = is_space & following(~is_space)
    kind = np.where(last, np.where(points == 0x20, LEAD, LAST), kind).astype(np.uint8)
    quote = points == 0x27
    kind[quote & following(_IS_ONE[np.minimum(points, 127)])] = SHORT_FORM
    for a, b in TWO_LETTERS:
        kind[quote & following((points == ord(a)) & following(points == ord(b)))] = LONG_FORM
    state = scan(np.where(front[:n], kind + 8, kind).astype(np.uint8))
    before = np.concatenate([[np.uint8(BETWEEN)], state[:-1]]) if n else state
    return np.flatnonzero(front[:n] | BEGINS[kind, before])


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Tokens:
    """The bytes of every id, side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, at: np.ndarray, total: int) -> np.ndarray:
        """``total`` bytes with the bytes of each of ``ids`` at its place ``at``; the tokens must fill them without gap."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id outside the vocabulary")
        size = self.lengths[ids]
        if (np.cumsum(size) - size != at).any() or int(size.sum()) != total:
            raise ValueError("offsets that don't fit the ids")
        place = np.arange(total) - np.repeat(at, size)
        return self.bytes[np.repeat(self.starts[ids], size) + place]


class Merger(Tokens):
    """Ids of pieces by the ranks of one vocabulary file; an id is its token's rank."""

    def __init__(self, path: str):
        self.ranks = _ranks(path)
        super().__init__(self.ranks)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError(f"{path} lacks single bytes")
        pairs = {self.ranks[t[:k]] * _SIZE + self.ranks[t[k:]]: r for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.table, self.held = WordTable(self._learn, MOST_WORDS), 0

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, ``_NONE`` where they don't merge."""
        key = left * _SIZE + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def _rounds(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of pieces, their ids in turn, numbers of ids) of short pieces, all of which merge one pair a round."""
        size = np.array([len(p) for p in pieces], np.int64)
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        which = np.arange(len(pieces))
        start = np.cumsum(size) - size
        rank = self._pair(ids, np.append(ids[1:], 0))
        rank[start + size - 1] = _NONE
        while len(which):
            low = np.minimum.reduceat(rank * _SIZE + np.arange(len(rank)), start)  # the leftmost of the lowest
            done = low >= _NONE * _SIZE
            if done.any():
                keep = np.repeat(~done, size)
                yield which[done], ids[~keep], size[done]
                ids, rank = ids[keep], rank[keep]
                which, size = which[~done], size[~done]
                start = np.cumsum(size) - size
                if not len(which):
                    break
                low = np.minimum.reduceat(rank * _SIZE + np.arange(len(rank)), start)
            at = low % _SIZE
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep]
            size = size - 1
            start = np.cumsum(size) - size
            at = at - np.arange(len(at))  # one id has gone from each piece before
            right, left = np.minimum(at + 1, len(ids) - 1), np.maximum(at - 1, 0)
            rank[at] = np.where(at == start + size - 1, _NONE, self._pair(ids[at], ids[right]))
            rank[left] = np.where(at == start, rank[left], self._pair(ids[left], ids[at]))

    def _heap(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece."""
        n, ranks = len(piece), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that begins at a byte
        alive = bytearray(b"\1") * n

        def offer(a: int) -> None:
            b = end[a]
            if b < n:
                rank = ranks.get(piece[a : end[b]])
                if rank is not None:
                    heapq.heappush(heap, (rank, a, b, end[b]))

        heap: list[tuple[int, int, int, int]] = []
        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if not alive[a] or end[a] != b or b >= n or not alive[b] or end[b] != c:
                continue
            alive[b], end[a] = 0, c
            if c < n:
                before[c] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        starts = [a for a in range(n) if alive[a]]
        return np.array([ranks[piece[a : end[a]]] for a in starts], np.int32)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first of each word, number of each word): whole tokens, then the short ones as they end, then the long ones."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        length = np.array([len(w) for w in words], np.int64)
        self.held += int(length.sum())
        known, short = np.flatnonzero(whole >= 0), np.flatnonzero((whole < 0) & (length <= SHORT)).tolist()
        found = [(known, whole[known], np.ones(len(known), np.int64))]
        for at in range(0, len(short), 2_000):  # positions stay below _SIZE
            part = np.array(short[at : at + 2_000])
            found += [(part[which], ids, size) for which, ids, size in self._rounds([words[k] for k in part.tolist()])]
        for k in np.flatnonzero((whole < 0) & (length > SHORT)).tolist():
            ids = self._heap(words[k])
            found.append((np.array([k]), ids, np.array([len(ids)])))
        which, ids, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        start[which], size[which] = np.cumsum(counts) - counts, counts
        return ids.astype(np.int32), start, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in turn, byte offset of each id in its text, number of ids of each text)."""
        table = self.table
        if self.held > MOST_BYTES or table.words > MOST_WORDS:
            table._clear()
            self.held = 0
        raw, offsets = buffers(texts)
        data = raw.tobytes()
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        first = np.searchsorted(lead, offsets)
        start = lead[piece_starts(points, first[:-1])]
        bounds = start.tolist() + [len(data)]
        pieces = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        key = np.fromiter(map(table.number.__getitem__, pieces), np.int64, len(pieces))
        table.ids([])  # learns the new ones
        size = table.size[key]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = table.flat[np.repeat(table.start[key] - (ends - size), size) + np.arange(total)]
        counts = np.diff(np.concatenate([[0], ends])[np.searchsorted(start, offsets)])
        length = self.lengths[ids]
        return ids, np.cumsum(length) - length - np.repeat(offsets[:-1], counts), counts


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """One merger a worker process and vocabulary file."""
    return Merger(path)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    """The tokens alone, for decoding."""
    return Tokens(_ranks(path))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values.astype(np.int32))


def _schema(rest: list, *new: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *new])


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of ``documents`` but ``text``, with the ``ids`` of the whole text and the byte ``offsets`` of their tokens."""
    path = path or default_path()
    rest = [f for f in documents.schema.fields if f.name.lower() not in ("text", "ids", "offsets")]
    names = [*(f.name for f in rest), "ids", "offsets"]

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in batches:
            for at, part in slices(strings(batch.column(len(rest)))):
                ids, offsets, counts = m.encode(part)
                own = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns[: len(rest)], _lists(ids, counts), _lists(offsets, counts)], names)

    return documents.select(*[f"`{f.name}`" for f in rest], "text").mapInArrow(made, _schema(rest, "ids array<int>", "offsets array<int>"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the bytes ``decoded`` in place of ``ids`` and ``offsets``; null ids or offsets decode to null."""
    path = path or default_path()
    rest = [f for f in encoded.schema.fields if f.name.lower() not in ("ids", "offsets", "decoded")]
    names = [*(f.name for f in rest), "decoded"]

    def bytes_of(t: Tokens, ids: pa.Array, offsets: pa.Array) -> pa.Array:
        missing = np.array([a or b for a, b in zip(ids.is_null().to_pylist(), offsets.is_null().to_pylist(), strict=True)], bool)
        flat, own = ids.flatten().to_numpy(zero_copy_only=False), offsets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.array([0 if n is None else n for n in ids.value_lengths().to_pylist()], np.int64)
        if len(flat) != len(own) or len(flat) != counts.sum():
            raise ValueError("ids and offsets of different lengths")
        size = np.concatenate([[0], np.cumsum(t.lengths[np.clip(flat, 0, len(t.lengths) - 1)])]) if len(flat) else np.zeros(1, np.int64)
        edge = size[np.concatenate([[0], np.cumsum(counts)])]
        data = t.decode(flat, own + np.repeat(edge[:-1], counts), int(edge[-1]))
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [pa.py_buffer(np.packbits(~missing, bitorder="little")), pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(path)
        for batch in batches:
            ids, offsets = batch.column(len(rest)), batch.column(len(rest) + 1)
            before = np.concatenate([[0], np.cumsum([n or 0 for n in ids.value_lengths().to_pylist()])])
            first, n = 0, batch.num_rows
            while first < n:  # rows of about SLICE_IDS ids; a longer text stands alone
                last = min(n, max(first + 1, int(np.searchsorted(before, before[first] + SLICE_IDS, "right")) - 1))
                own = slice(first, last)
                part = bytes_of(t, ids[own], offsets[own])
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns[: len(rest)], part], names)
                first = last

    return encoded.select(*[f"`{f.name}`" for f in rest], "ids", "offsets").mapInArrow(made, _schema(rest, "decoded binary"))
