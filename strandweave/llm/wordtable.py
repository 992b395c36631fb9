"""Ids of words, learnt once and laid out flat, so that whole batches of texts are put together by gathers."""

from __future__ import annotations

from collections.abc import Callable, Hashable

import numpy as np


class _Numbers(dict):
    """A number for each key, in the order of first sight."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class WordTable:
    """Keeps the ids of up to about ``most`` words, then starts anew.

    ``learn(words)`` gives (all ids, first id of each word, number of ids of each word).
    """

    def __init__(self, learn: Callable[[list], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int):
        self.learn, self.most = learn, most
        self._clear()

    def _clear(self) -> None:
        self.number = _Numbers()
        self.flat, self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.words = self.used = 0

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        old = getattr(self, name)
        if at + len(values) > len(old):
            grown = np.zeros(max(at + len(values), 2 * len(old)), old.dtype)
            grown[:at] = old[:at]
            setattr(self, name, grown)
        getattr(self, name)[at : at + len(values)] = values

    def ids(self, texts: list[list[Hashable]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each text) of texts that are given as lists of words."""
        if self.words > self.most:
            self._clear()
        look = self.number.__getitem__
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        key = np.fromiter((n for t in texts for n in map(look, t)), np.int64, int(counts.sum()))
        if new := self.number.new:
            self.number.new = []
            flat, start, size = self.learn(new)
            self._put("flat", self.used, flat)
            self._put("start", self.words, start + self.used)
            self._put("size", self.words, size)
            self.used += len(flat)
            self.words += len(new)
        size = self.size[key]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        found = self.flat[np.repeat(self.start[key] - (ends - size), size) + np.arange(total)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return found, np.diff(edges)
