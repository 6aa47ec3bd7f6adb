"""Encoding of texts segment by segment, each distinct segment once in a while.

A segment boundary is a place that no match of a tokenizer's splitting pattern can cross, so the ids of a
text are those of its segments one after the other. Workers keep the ids of the segments that they have
met, up to a number of characters; then they start anew.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

CACHE_CHARS = 4_000_000
TEXT_BYTES = 1 << 19


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start[i] .. start[i] + length[i] - 1 of every i, one after the other."""
    total = np.cumsum(length)
    n = int(total[-1]) if len(total) else 0
    return np.repeat(start - total + length, length) + np.arange(n)


def flattened(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and the number in each list."""
    length = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum())), length


class _Places(dict):
    """Segments in the order in which they were first asked for; `new` has those since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, segment: str | bytes) -> int:
        at = self[segment] = len(self)
        self.new.append(segment)
        return at


class SegmentEncoder:
    """split gives a text's segments, as str or bytes; encode the ids of many segments, one after the other, and the number of each."""

    def __init__(self, split: Callable[[str | bytes], list], encode: Callable[[list], tuple[np.ndarray, np.ndarray]], chars: int = CACHE_CHARS):
        self.split, self.encode, self.most = split, encode, chars
        self.clear()

    def clear(self) -> None:
        self.place = _Places()
        self.chars, self.ids, self.start, self.length = 0, np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n_ids = 0

    def _learn(self) -> None:
        new, self.place.new = self.place.new, []
        flat, length = self.encode(new)
        at = len(self.place) - len(new)
        self.chars += sum(map(len, new))
        for name, need in (("ids", self.n_ids + len(flat)), ("start", len(self.place)), ("length", len(self.place))):
            have = getattr(self, name)
            if len(have) < need:
                setattr(self, name, np.concatenate([have, np.zeros(max(need - len(have), len(have)), have.dtype)]))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.start[at : at + len(new)] = self.n_ids + np.cumsum(length) - length
        self.length[at : at + len(new)] = length
        self.n_ids += len(flat)

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each."""
        parts = [self.split(t) for t in texts]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        if self.chars > self.most:
            self.clear()
        which = np.fromiter(map(self.place.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
        if self.place.new:
            self._learn()
        length = self.length[which]
        total = np.concatenate([[0], np.cumsum(length)])
        return self.ids[ragged(self.start[which], length)], np.diff(total[np.concatenate([[0], np.cumsum(n)])])
