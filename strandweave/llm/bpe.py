"""Byte-level BPE ids of whole texts, as the ``tokenizers`` library gives them, each distinct word encoded once a task.

The vocabulary is read from the library's own file; words are encoded by ``tiktoken``, which takes a word in a
third of the time and gives the same ids (a test compares the two on whole texts).  In a text without two blanks
in a row, splitting into words never looks across a single blank, so the ids of a text are those of its blank-led
pieces in turn.  Other texts are encoded whole.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from .wordtable import WordTable

MOST_WORDS = 800_000
#: Fixed value: how byte-level BPE of this vocabulary splits text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks(path: str) -> dict[bytes, int]:
    """Bytes and id of every ordinary token; ids follow the order of the merges.

    The file writes a byte as a printable character: itself where it has one, else the next of those from U+0100.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    special = {t["content"] for t in found["added_tokens"]}
    return {bytes(byte[c] for c in token): n for token, n in found["model"]["vocab"].items() if token not in special}


class Encoder:
    """Ids of texts by the vocabulary file at ``path``; special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        self.whole = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary
        self.table = WordTable(self._learn, MOST_WORDS)

    def _learn(self, words: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = [self.whole(w[0] if isinstance(w, tuple) else " " + w) for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(size.sum())), np.cumsum(size) - size, size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each text)."""
        odd = {k: np.array(self.whole(t), np.int32) for k, t in enumerate(texts) if "  " in t}
        split = []
        for k, t in enumerate(texts):
            pieces = t.split(" ") if t and k not in odd else []
            if pieces:
                pieces[0] = (pieces[0],)  # no blank before it
            split.append(pieces)
        ids, lengths = self.table.ids(split)
        if not odd:
            return ids, lengths
        edges = np.concatenate([[0], np.cumsum(lengths)])
        parts = [odd.get(k, ids[edges[k] : edges[k + 1]]) for k in range(len(texts))]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
