"""Signature trees over sets: nodes hold OR-combined bitmaps and size ranges."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from quartier.llm import textkernel as K

FAN_OUT = 8
PAIR_WORDS = 1 << 20


def size_class(n: np.ndarray) -> np.ndarray:
    """Sets of a class have bitmaps of one width, about 3 bits for each element."""
    return np.clip(np.floor(np.log2(np.maximum(n, 1))).astype(np.int64), 3, 16)


def width(cls: int) -> int:
    """64-bit words of a class's bitmaps."""
    return max(1, (1 << (cls + 2)) >> 6)


def bitmap(s: np.ndarray, cls: int) -> np.ndarray:
    out = np.zeros(width(cls), K.U64)
    at = s >> K.U64(64 - (cls + 2))
    np.bitwise_or.at(out, (at >> K.U64(6)).astype(np.int64), K.U64(1) << (at & K.U64(63)))
    return out


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap that sets of these sizes need for a Jaccard similarity of 0.8."""
    return -(-4 * (a + b) // 9)


class Groups:
    """Union-find by labels, kept flat."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        self.label[self.label == max(x, y)] = min(x, y)
        return True


def join(size: np.ndarray, bits: np.ndarray, order: np.ndarray, groups: Groups, accept: Callable[[int, int], bool], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Accepted pairs that link all that can be linked: a spanning forest of the accepted links.

    size and bits: of each set; order: similar sets near each other. Node pairs are left out when the bits that their ORs share, with what hash
    collisions may hide, are fewer than the least overlap of their smallest sets, when their size ranges lie more than 5/4 apart,
    or when all their sets are linked already. side: sets of one side other than 3 need no comparison with each other.
    """
    n = len(size)
    size, bits = size[order], bits[order]
    hidden = size - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    levels = [(bits, size, size, hidden)]
    while len(levels[-1][1]) > FAN_OUT:
        b, lo, hi, h = levels[-1]
        at = np.arange(0, len(lo), FAN_OUT)
        levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(h, at)))
    count = len(levels[-1][1])
    stack = [(len(levels) - 1, *np.triu_indices(count))]
    found = []
    most = max(1, PAIR_WORDS // bits.shape[1])
    while stack:
        level, i, j = stack.pop()
        if len(i) > most:
            stack += [(level, i[k : k + most], j[k : k + most]) for k in range(0, len(i), most)][::-1]
            continue
        b, lo, hi, h = levels[level]
        if level == 0:
            i, j = i[i < j], j[i < j]
            x, y = order[i], order[j]
            ok = groups.label[x] != groups.label[y]
            if side is not None:
                ok &= (side[x] == 3) | (side[x] != side[y])
            i, j = i[ok], j[ok]
            only_i, only_j = (np.bitwise_count(p & ~q).sum(axis=1).astype(np.int64) for p, q in ((b[i], b[j]), (b[j], b[i])))
            ok = np.minimum(size[i] - only_i, size[j] - only_j) >= least_overlap(size[i], size[j])
            for p, q in zip(order[i[ok]].tolist(), order[j[ok]].tolist(), strict=True):
                if groups.label[p] != groups.label[q] and accept(p, q):
                    groups.join(p, q)
                    found.append((p, q))
            continue
        shared = np.bitwise_count(b[i] & b[j]).sum(axis=1).astype(np.int64) + np.minimum(h[i], h[j])
        ok = (np.minimum(shared, np.minimum(hi[i], hi[j])) >= least_overlap(lo[i], lo[j])) & (4 * lo[i] <= 5 * hi[j]) & (4 * lo[j] <= 5 * hi[i])
        i, j = i[ok], j[ok]
        wide, below = FAN_OUT, len(levels[level - 1][1])
        # children of a node pair; a node with itself gives each pair of its children once
        ci = (i[:, None] * wide + np.repeat(np.arange(wide), wide)[None, :]).ravel()
        cj = (j[:, None] * wide + np.tile(np.arange(wide), wide)[None, :]).ravel()
        ok = (ci < below) & (cj < below) & (ci <= cj)
        if level == 1:
            first = groups.label[order]
            same = (np.minimum.reduceat(first, np.arange(0, n, wide)), np.maximum.reduceat(first, np.arange(0, n, wide)))
            done = (same[0][i] == same[1][i]) & (same[0][j] == same[1][j]) & (same[0][i] == same[0][j])
            ok &= ~np.repeat(done, wide * wide)
        ci, cj = ci[ok], cj[ok]
        near = np.argsort(cj - ci, kind="stable")  # near neighbours first: they link most
        stack.append((level - 1, ci[near], cj[near]))
    return found
