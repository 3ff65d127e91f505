"""Signature trees over sets in a task: OR-combined bitmaps with size ranges, and their dual traversal.

A set of n tokens is represented by its size, by how many of its tokens lie in a fixed quarter of the hash space
(m), and by a bitmap of that quarter whose width follows n. Two sets share at most

    popcount(bitmap & bitmap) + min(m - popcount, ...) + min(n - m, ...)

tokens: equal bits, tokens hidden behind a bit already set, and tokens outside the quarter. A node has the OR of
its members' bitmaps and the largest of the other terms, so the same bound holds for every pair under two nodes.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
SMALLEST, WIDEST = 6, 17  # bits of a bitmap as powers of two


def width_class(n: np.ndarray | int):
    """The power of two of the bitmap's bits: the next one from n."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1))).astype(int), SMALLEST, WIDEST)


def bitmap(tokens: np.ndarray, n: int) -> bytes:
    """Bits chosen by the tokens' low bits, so that a narrower bitmap is the OR of the parts of a wider one."""
    w = int(width_class(n))
    bits = np.zeros(1 << w, np.uint8)
    bits[(tokens & np.uint64((1 << w) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, to: int) -> np.ndarray:
    """Rows of 64-bit words narrowed to ``1 << to`` bits by OR."""
    words = (1 << to) // 64
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class Level:
    """Nodes of one level: bitmaps, hidden and outside maxima, size ranges, and ranges of component labels."""

    def __init__(self, bits, hidden, outside, low, high, comp_low, comp_high):
        self.bits, self.hidden, self.outside, self.low, self.high = bits, hidden, outside, low, high
        self.comp_low, self.comp_high = comp_low, comp_high

    def parents(self) -> Level:
        at = np.arange(0, len(self.low), FANOUT)
        top = lambda f, x: f.reduceat(x, at)
        return Level(np.bitwise_or.reduceat(self.bits, at, axis=0), top(np.maximum, self.hidden), top(np.maximum, self.outside), top(np.minimum, self.low), top(np.maximum, self.high), top(np.minimum, self.comp_low), top(np.maximum, self.comp_high))


def bound(x: Level, i: np.ndarray, y: Level, j: np.ndarray) -> np.ndarray:
    """The largest possible overlap of pairs of nodes."""
    same = np.bitwise_count(x.bits[i] & y.bits[j]).sum(axis=1, dtype=np.int64)
    return same + np.minimum(x.hidden[i], y.hidden[j]) + np.minimum(x.outside[i], y.outside[j])


def possible(x: Level, i: np.ndarray, y: Level, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of nodes can hold a link between different components, and their bounds."""
    sized = (100 * x.high[i] >= percent * y.low[j]) & (100 * y.high[j] >= percent * x.low[i])
    apart = (x.comp_low[i] != x.comp_high[i]) | (y.comp_low[j] != y.comp_high[j]) | (x.comp_low[i] != y.comp_low[j])
    ok = sized & apart
    most = np.zeros(len(i), np.int64)
    most[ok] = bound(x, i[ok], y, j[ok])
    return ok & ((100 + percent) * most >= percent * (x.low[i] + y.low[j])), most


def tree(leaves: Level) -> list[Level]:
    levels = [leaves]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].parents())
    return levels


def traverse(a: list[Level], b: list[Level] | None, percent: int, slice_: int = 1 << 16):
    """Pairs of leaves (i, j, bound) of two trees, or of one tree with itself, that no node pair above rules out.

    Depth first in slices, so that a task holds a bounded number of open node pairs.
    """
    own = b is None
    b = a if own else b
    todo = [(len(a) - 1, len(b) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        la, lb, i, j = todo.pop()
        ok, most = possible(a[la], i, b[lb], j, percent)
        if own and la == lb == 0:
            ok &= i < j
        i, j, most = i[ok], j[ok], most[ok]
        if not len(i):
            continue
        if la == lb == 0:
            yield i, j, most
            continue
        na, nb = max(la - 1, 0), max(lb - 1, 0)
        step_a, step_b = (FANOUT if la else 1), (FANOUT if lb else 1)
        ca = (i[:, None] * step_a + np.arange(step_a))[:, :, None]
        cb = (j[:, None] * step_b + np.arange(step_b))[:, None, :]
        ca, cb = np.broadcast_arrays(ca, cb)
        ca, cb = ca.ravel(), cb.ravel()
        real = (ca < len(a[na].low)) & (cb < len(b[nb].low))
        if own and na == nb:
            real &= ca <= cb
        ca, cb = ca[real], cb[real]
        for s in range(0, len(ca), slice_):
            todo.append((na, nb, ca[s:s + slice_], cb[s:s + slice_]))
