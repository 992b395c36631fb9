"""SentencePiece encoding and decoding with a batched numpy Viterbi.

The vocabulary comes from a SentencePiece model file (pieces, scores, normaliser switches).  Blanks become the
meta symbol; since no piece holds one after another character, a text's best segmentation is that of its words
(a run of meta symbols and what follows up to the next) in turn.  Distinct words of equal length advance together:
prefix hashes give every substring's hash, sorted piece keys are probed, and one vectorised maximum a position
stores score and backpointer.  Characters that no piece covers get the unknown score and, where the model has byte
pieces, are written as their UTF-8 bytes.

The segmentation is the one of highest summed score (of several, the one whose last piece is longest, and so on
to the front).  Decoding restores blanks and bytes; with the model's own dummy prefix the first blank is dropped.
Null text counts as empty; an empty text has no ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import slices, strings
from .wordtable import WordTable

META = "▁"
UNKNOWN_PENALTY = 10.0
MOST_WORDS = 300_000
_STEP = np.uint64(0xD1342543DE82EF95)
_WORD = re.compile(f"{META}*[^{META}]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(field number, value) of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Pieces and scores of a model file, with hashed keys for probing."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.dummy_prefix = self.squeeze = True
        self.byte_fallback = False
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.kinds.append(kind)
                scores.append(score)
            elif number == 2:
                self.byte_fallback = bool(dict(_fields(value)).get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(1, b"identity") not in (b"identity", b""):
                    raise ValueError("only models that keep text as it is are supported")
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        normal = [k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)) if kind == 1 and p]
        if any(META in self.pieces[k].lstrip(META) for k in normal):
            raise ValueError("a piece spans words")
        self.unknown = self.kinds.index(2)
        self.unknown_score = min(scores[k] for k in normal) - UNKNOWN_PENALTY
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if self.kinds[k] == 6}
        keys, ids = [], []
        self.longest = max(len(self.pieces[k]) for k in normal)
        for size in range(1, self.longest + 1):
            own = [k for k in normal if len(self.pieces[k]) == size]
            if own:
                points = np.array([[ord(c) for c in self.pieces[k]] for k in own], np.uint64)
                keys.append(_hash(points))
                ids += own
        order = np.argsort(np.concatenate(keys))
        self.keys = np.concatenate(keys)[order]
        self.ids = np.array(ids)[order]
        self.scores = np.array(scores)
        low = {k: chr(b) for b, k in self.bytes.items() if b < 128}
        self.written = np.array([low.get(k, {1: p, 2: " ⁇ "}.get(kind, "")) for k, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True))], object)
        self.plain = np.array([kind != 6 or k in low for k, kind in enumerate(self.kinds)])
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.table = WordTable(self._learn, MOST_WORDS)
        self.ascii = np.array([self.bytes.get(b, self.unknown) if self.byte_fallback else self.unknown for b in range(128)], np.int32)

    def viterbi(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, lengths) that end at each position of words of one length: ``rows`` has a word's code points a row."""
        n, size = rows.shape
        most = min(self.longest, size)
        score = np.full((n, most, size), -np.inf)
        piece = np.zeros((n, most, size), np.int32)
        h = np.zeros((n, size), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(most):  # h[:, i]: hash of the k + 1 points that end at i
                h[:, k:] = (h[:, k - 1 : -1] if k else 0) * _STEP + _spread(rows[:, k:])
                own = _finish(h[:, k:], k + 1)
                at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
                hit = self.keys[at] == own
                found = self.ids[at]
                score[:, k, k:] = np.where(hit, self.scores[found], -np.inf)
                piece[:, k, k:] = found
        missing = np.isneginf(score[:, 0])
        score[:, 0][missing] = self.unknown_score
        points = rows[missing]
        piece[:, 0][missing] = np.where(points < 128, self.ascii[np.minimum(points, 127).astype(np.int64)], self.unknown)
        best = np.zeros((n, size + 1))
        back = np.zeros((n, size), np.int32)
        pick = np.arange(n)
        for i in range(size):
            reach = min(most, i + 1)
            total = score[:, reach - 1 :: -1, i] if reach == most else score[:, :reach, i][:, ::-1]
            total = total + best[:, i + 1 - reach : i + 1]
            longest = total.argmax(1)  # the first maximum is the longest piece
            best[:, i + 1] = total[pick, longest]
            back[:, i] = reach - longest
        return piece[pick[:, None], back - 1, np.arange(size)], back

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment new words, those of one length together."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        flat, used = [], 0
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            step = max(1, (1 << 21) // (n * min(n, self.longest)))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                rows = np.frombuffer("".join([words[k] for k in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n).astype(np.uint64)
                piece, back = self.viterbi(rows)
                ends = np.zeros((len(part), n), bool)
                left, pick = np.full(len(part), n), np.arange(len(part))
                while len(pick):
                    ends[pick, left - 1] = True
                    left = left - back[pick, left - 1]
                    on = left > 0
                    pick, left = pick[on], left[on]
                count = ends.sum(1)
                start[part], size[part] = used + np.cumsum(count) - count, count
                flat.append(piece[ends])
                used += len(flat[-1])
                odd = ((piece == self.unknown) & ends).any(1) if self.byte_fallback and self.bytes else np.zeros(len(part), bool)
                for k in np.flatnonzero(odd).tolist():  # unknown characters beyond ASCII
                    ids = self._as_bytes(words[part[k]], piece[k][ends[k]], np.flatnonzero(ends[k]))
                    start[part[k]], size[part[k]] = used, len(ids)
                    flat.append(ids)
                    used += len(ids)
        return np.concatenate(flat), start, size

    def _as_bytes(self, word: str, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out: list[int] = []
        for k, end in zip(ids.tolist(), ends.tolist(), strict=True):
            out += [self.bytes[b] for b in word[end].encode("utf-8", "surrogatepass")] if k == self.unknown else [k]
        return np.array(out, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each text)."""
        return self.table.ids([self.split(t) for t in texts])

    def split(self, text: str) -> list[str]:
        """Words of the normalised text, each with its meta symbols."""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        text = text.replace(" ", META)
        if self.dummy_prefix:
            text = META + text
        return [w for w in _WORD.findall(text) if w]

    def decode(self, ids: np.ndarray) -> str:
        parts, run = [], bytearray()
        ids = np.asarray(ids)
        plain = self.plain[ids]
        if plain.all():  # no bytes that stand alone for a part of a character
            text = "".join(self.written[ids]).replace(META, " ")
            return text[1:] if self.dummy_prefix and text.startswith(" ") else text
        back = {k: b for b, k in self.bytes.items()}
        for k in ids.tolist():
            if k in back:
                run.append(back[k])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run.clear()
            if self.kinds[k] == 1:
                parts.append(self.pieces[k])
            elif self.kinds[k] == 2:
                parts.append(" ⁇ ")
        if run:
            parts.append(run.decode("utf-8", "replace"))
        text = "".join(parts).replace(META, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _spread(points: np.ndarray) -> np.ndarray:
    x = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def _finish(h: np.ndarray, size: int) -> np.ndarray:
    x = h + np.uint64(size)
    return (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)


def _hash(points: np.ndarray) -> np.ndarray:
    """Hashes of rows of code points, as :meth:`Vocabulary.viterbi` builds them."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(points), np.uint64)
        for k in range(points.shape[1]):
            h = h * _STEP + _spread(points[:, k])
        return _finish(h, points.shape[1])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a worker process and model file."""
    return Vocabulary(path)


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), ids)


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of ``documents`` but ``text``, with the piece ``ids`` of the whole text."""
    path = path or default_path()
    rest = [f for f in documents.schema.fields if f.name not in ("text", "ids")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "ids array<int>"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = strings(batch.column(batch.schema.get_field_index("text")))
            for at, part in slices(texts, 1 << 22):
                ids, sizes = v.encode(part.to_pylist())
                own = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*(own.column(f.name) for f in rest), _lists(ids, sizes)], [*(f.name for f in rest), "ids"])

    return documents.select(*[f"`{f.name}`" for f in rest], "text").mapInArrow(made, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the ``text`` that its ``ids`` stand for, in place of ``ids``."""
    path = path or default_path()
    rest = [f for f in encoded.schema.fields if f.name not in ("text", "ids")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "text string"])

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for pdf in batches:
            yield pdf.drop(columns=["ids"]).assign(text=[None if x is None else v.decode(x) for x in pdf["ids"]])

    return encoded.select(*[f"`{f.name}`" for f in rest], "ids").mapInPandas(made, schema)


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_ids, ids_crc32, decoded_chars, decoded_sha256, same): both directions over whole texts.

    ``same`` tells whether decoding gives the text back, with meta symbols of the text itself as blanks.
    """
    path = path or default_path()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for at, part in slices(strings(batch.column(1)), 1 << 22):
                texts = part.to_pylist()
                ids, sizes = v.encode(texts)
                own = np.split(ids, np.cumsum(sizes)[:-1])
                back = [v.decode(x) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), _lists(ids, sizes), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()), pa.array(back), pa.array([b == t.replace(META, " ") for b, t in zip(back, texts, strict=True)])],
                    ["doc_id", "ids", "ids_crc32", "decoded", "same"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, ids array<int>, ids_crc32 bigint, decoded string, same boolean")
    return rows.select("doc_id", "ids", F.size("ids").alias("n_ids"), "ids_crc32", F.char_length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"), "same")
