"""Vectorised word and line kernels over Arrow string batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. All of these separators are single
bytes in UTF-8, so the kernels work on the UTF-8 bytes of a whole batch at once: a polynomial
prefix hash gives the 64-bit hash of every word, line or window without a Python loop over words.
Equality of words is decided by these 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WINDOW = 5
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_COEF = _rng.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}
_held = [np.empty(0, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, CHUNK_BYTES + 1), base, U64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def _scratch(n: int) -> np.ndarray:
    """Memory for n values that the next call takes again, so that it is mapped once."""
    if len(_held[0]) < n:
        _held[0] = np.empty(max(n, CHUNK_BYTES + 1), U64)
    return _held[0][:n]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named string column with nulls as empty strings."""
    a = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(a.type):
        a = a.cast(pa.string())
    return a.fill_null("") if a.null_count else a


def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offset of each string, from 0."""
    off = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4).astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(a: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    _, off = raw(a)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _inside_words(data: np.ndarray) -> np.ndarray:
    """Bytes other than 0x20 and 0x09-0x0D; those below 0x09 wrap around."""
    return (data - np.uint8(9) > np.uint8(4)) & (data != np.uint8(32))


def runs(off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are inside; runs end with their texts."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(n + 1, bool)
    change[0], change[n] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=change[1:n])
    edges = np.flatnonzero(change)
    start, end = edges[::2], edges[1::2]
    # texts that meet within a run cut it
    joint = np.unique(off[(off > 0) & (off < n)])
    joint = joint[inside[joint] & inside[joint - 1]]
    if len(joint):
        start, end = np.insert(start, np.searchsorted(start, joint), joint), np.insert(end, np.searchsorted(end, joint), joint)
    return start, end


def word_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where each word starts; nothing is hashed."""
    return runs(off, _inside_words(data))[0]


class Spans:
    """Runs of bytes: hash, start and end of each, and for each text the offset of its first run."""

    def __init__(self, data: np.ndarray, off: np.ndarray, inside: np.ndarray, lower: bool):
        n = len(data)
        self.start, self.end = runs(off, inside)
        total = _scratch(n + 1)
        total[0], sums = 0, total[1:]
        (_LOWER if lower else _BYTE).take(data, mode="clip", out=sums)
        np.multiply(sums, _power(_BASE, n), out=sums)
        np.cumsum(sums, out=sums)
        self.hash = mix((total[self.end] - total[self.start]) * _power(_INVERSE, n + 1)[self.start] + (self.end - self.start).astype(U64))
        self.off = np.searchsorted(self.start, off)
        self.count = np.diff(self.off)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> Spans:
    return Spans(data, off, _inside_words(data), lower)


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, split at line feeds as str.split does, and the text of each line."""
    feeds = np.flatnonzero(data == 10)
    text = np.searchsorted(off, feeds, "right") - 1
    start = np.concatenate([off[:-1], feeds + 1])
    end = np.concatenate([feeds, off[1:]])
    by = np.concatenate([np.arange(len(off) - 1), text])
    a, b = np.lexsort((start, by)), np.lexsort((end, np.concatenate([text, np.arange(len(off) - 1)])))
    return start[a], end[b], by[a]


def windows(w: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Hash of the `size` words from each word on; short by size - 1."""
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = w[:n] * _COEF[0]
    for j in range(1, size):
        h += w[j : n + j] * _COEF[j]
    return mix(h)


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags between each two offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def rolling(w: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """Hash of the `size` words from each word on, for any size at the cost of one; short by size - 1. The base is odd."""
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(w) + 1, U64)
    np.cumsum(w * _power(base, len(w)), out=total[1:])
    return mix((total[size:] - total[:n]) * _power(pow(base, -1, 2**64), n))
