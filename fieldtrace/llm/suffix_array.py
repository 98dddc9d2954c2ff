"""Suffix arrays by induced sorting and permuted common prefixes, in numpy."""

from __future__ import annotations

import numpy as np


def spread(heads: np.ndarray, symbols: np.ndarray, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places at the heads (or, backwards, the tails) of the buckets for symbols in this order; moves the heads."""
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    counts = np.bincount(ranked, minlength=len(heads))
    rank = np.arange(len(ranked)) - (np.cumsum(counts) - counts)[ranked]
    places = heads[ranked] - 1 - rank if backwards else heads[ranked] + rank
    heads += -counts if backwards else counts
    return places, order


def induce(t: np.ndarray, small: np.ndarray, ends: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order: larger ones in a pass to the right, smaller ones in one to the left.

    Each pass takes a bucket at a time, and within it waves of suffixes: a wave's predecessors go to later buckets, or
    to this one, where they make the next wave.
    """
    sa = np.full(len(t), -1, np.int64)
    starts = np.append(0, ends[:-1])
    heads, tails = starts.copy(), ends.copy()
    places, order = spread(tails, t[leftmost[::-1]], backwards=True)
    sa[places] = leftmost[::-1][order]
    kept = tails.copy()  # the leftmost-smaller ones of bucket c lie from here to ends[c]

    def wave(some: np.ndarray, larger: bool) -> None:
        before = some - 1
        before = before[before >= 0]
        before = before[small[before] != larger]
        if len(before):
            places, order = spread(heads if larger else tails, t[before], not larger)
            sa[places] = before[order]

    used = np.flatnonzero(ends > starts)
    for c in used:
        at = starts[c]
        while at < heads[c]:
            some, at = sa[at : heads[c]].copy(), heads[c]
            wave(some, True)
        if kept[c] < ends[c]:
            wave(sa[kept[c] : ends[c]].copy(), True)
    tails = ends.copy()
    for c in used[::-1]:
        at = ends[c]
        while at > tails[c]:
            some, at = sa[tails[c] : at][::-1].copy(), tails[c]
            wave(some, False)
        if heads[c] > starts[c]:
            wave(sa[starts[c] : heads[c]][::-1].copy(), False)
    return sa


def doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string with a large alphabet, by doubling the length that is sorted by."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of data (small numbers: bytes, or bytes and a separator) in order; the end of data is smaller than any of them."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    t = np.append(data.astype(np.int64) + 1, 0)
    size = n + 1
    # A suffix is smaller than the next one if the next different symbol is larger.
    change = np.flatnonzero(t[1:] != t[:-1])
    following = change[np.minimum(np.searchsorted(change, np.arange(n)), len(change) - 1)]
    small = np.append(t[following + 1] > t[following], True)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(t))
    sa = induce(t, small, ends, leftmost)
    if len(leftmost) > 1:
        # Equal neighbours among the sorted substrings from one leftmost-smaller place to the next get one name.
        is_left = np.zeros(size, bool)
        is_left[leftmost] = True
        ordered = sa[is_left[sa]]
        index = np.zeros(size, np.int64)
        index[leftmost] = np.arange(len(leftmost))
        length = np.append(np.diff(leftmost), 0) + 1
        a, b = ordered[:-1], ordered[1:]
        same = length[index[a]] == length[index[b]]
        open_, step = np.flatnonzero(same), 0
        while len(open_):
            equal = t[a[open_] + step] == t[b[open_] + step]
            same[open_[~equal]] = False
            step += 1
            open_ = open_[equal]
            open_ = open_[length[index[a[open_]]] > step]
        names = np.empty(len(leftmost), np.int64)
        names[index[ordered]] = np.concatenate([[0], np.cumsum(~same)])
        if names.max() < len(names) - 1:
            ordered = leftmost[doubled(names)]
        sa = induce(t, small, ends, ordered)
    return sa[1:]


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in the order of the text: the one before it in sa (-1: none), and the length of their common prefix.

    Only where the symbols before the two differ is a length counted; elsewhere it is one less than its neighbour's.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    counted = (before <= 0) | (at == 0)
    inner = ~counted
    counted[inner] = data[at[inner] - 1] != data[before[inner] - 1]
    # Seven symbols of nine bits are compared at once.
    padded = np.append(data, np.zeros(7, data.dtype)).astype(np.uint64)
    words = np.zeros(n + 1, np.uint64)
    for k in range(7):
        words |= padded[k : k + n + 1] << np.uint64(54 - 9 * k)
    lengths = np.zeros(n, np.int64)
    open_ = np.flatnonzero(counted & (before >= 0))
    while len(open_):
        a, b = open_ + lengths[open_], before[open_] + lengths[open_]
        room = n - np.maximum(a, b)
        different = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        equal = np.full(len(open_), 7, np.int64)
        for k in range(6, -1, -1):
            equal[different >> np.uint64(54 - 9 * k) != 0] = k
        equal = np.minimum(equal, room)
        lengths[open_] += equal
        open_ = open_[(equal == 7) & (room > 7)]
    reach = np.maximum.accumulate(np.where(counted, lengths + at, 0))
    return before, np.where(before >= 0, np.maximum(reach - at, 0), 0)
