"""Signature trees: bitmaps of token sets, ORed up a hierarchy, and the traversal of two of them at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from fieldtrace.llm.blobs import mixed

FANOUT = 8
#: Pairs of nodes that are opened at once.
CHUNK = 1 << 13


def width_for(size: int) -> int:
    """Bits of the bitmap of a set: the power of two from one and a half times its size, 64 to 65,536."""
    return min(1 << 16, max(64, 1 << int(1.5 * size).bit_length()))


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, bool)
    bits[(mixed(tokens) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


class Tree:
    """Levels of nodes, the sets themselves first: bitmaps, smallest and largest size, and most tokens that share a bit with another."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        excess = sizes - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, excess = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))


def pair_chunks(tree: Tree, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets a < b whose Jaccard similarity may reach least percent, in chunks: both trees of a self-join descended together, depth first.

    A pair of nodes goes on if the sizes allow it and the most tokens that sets below may have in common, those in
    the common bits and those hidden behind them, are enough for the smallest sets. At most CHUNK pairs of nodes open at once,
    so what waits is bounded by the depth of the tree.
    """
    child = np.arange(FANOUT)
    waiting = [(len(tree.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while waiting:
        level, left, right = waiting.pop()
        bits, low, high, excess = tree.levels[level]
        keep = (100 * high[left] >= least * low[right]) & (100 * high[right] >= least * low[left])
        left, right = left[keep], right[keep]
        most = np.empty(len(left), np.int64)
        for lo in range(0, len(left), 1 << 14):
            a, b = left[lo : lo + (1 << 14)], right[lo : lo + (1 << 14)]
            most[lo : lo + (1 << 14)] = np.bitwise_count(bits[a] & bits[b]).sum(axis=1) + np.minimum(excess[a], excess[b])
        keep = (100 + least) * most >= least * (low[left] + low[right])
        left, right = left[keep], right[keep]
        if not level:
            different = left < right
            yield left[different], right[different]
        elif len(left) > CHUNK:
            # Checked again when they are taken up, which is cheap beside opening them.
            waiting += [(level, left[lo : lo + CHUNK], right[lo : lo + CHUNK]) for lo in range(0, len(left), CHUNK)]
        elif len(left):
            left = np.repeat(left[:, None] * FANOUT + child, FANOUT, axis=1).ravel()
            right = np.tile(right[:, None] * FANOUT + child, (1, FANOUT)).ravel()
            inside = (left < len(tree.levels[level - 1][0])) & (right < len(tree.levels[level - 1][0])) & (left <= right)
            waiting.append((level - 1, left[inside], right[inside]))


def pairs(tree: Tree, least: int) -> tuple[np.ndarray, np.ndarray]:
    """All of pair_chunks() at once."""
    found = list(pair_chunks(tree, least)) or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def close(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether two sorted sets reach least percent, exactly."""
    if 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= least * (len(a) + len(b) - common)


def linked(sets: list[np.ndarray], least: int, root: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join sets which are close, as far as they are not joined already; root names the group of each set and is updated."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((np.array([s[0] for s in sets]), sizes))
    sizes = sizes[order]
    width = width_for(int(sizes[0]))
    bits = np.stack([bitmap(sets[k], width) for k in order])
    a, b = pairs(Tree(sizes, bits), least)
    a, b = order[a], order[b]
    edges = []
    while True:
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return edges
        # A pair for each group that still has one.
        some = np.unique(root[a], return_index=True)[1]
        for k in some:
            i, j = int(a[k]), int(b[k])
            if root[i] != root[j] and close(sets[i], sets[j], least):
                edges.append((i, j))
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
        rest = np.ones(len(a), bool)
        rest[some] = False
        a, b = a[rest], b[rest]
