"""Suffix arrays by induced sorting, and permuted common prefixes, on NumPy arrays.

suffix_array() follows SA-IS. Suffixes are classified as larger (L) or smaller (S) than their successor; the substrings
between leftmost-smaller (LMS) positions are sorted and named; where names repeat, the string of names is sorted the same
way, recursively. At the top level, whose alphabet is small, the full order is induced from the LMS suffixes in two linear
scans: buckets are visited in order, and a bucket's entries place their predecessors as one stable counting step (again
for those that land in the same bucket, which are as many waves as the longest run of a symbol). Inside the recursion,
where the alphabet is as large as the string, a suffix is ranked by its symbols up to the next LMS position and then by
the rank of that LMS suffix.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one counts as smaller."""
    n = len(s)
    change = np.flatnonzero(s[1:] != s[:-1])  # s[i] differs from s[i + 1]
    smaller = np.ones(n, bool)
    if len(change):
        at = np.minimum(np.searchsorted(change, np.arange(n - 1)), len(change) - 1)
        nearest = change[at]
        smaller[:-1] = s[nearest] < s[nearest + 1]
    return smaller


def _refine(symbols: np.ndarray, bits: int, starts: np.ndarray, ends: np.ndarray, tails: np.ndarray | None = None) -> np.ndarray:
    """Rank of each stretch symbols[start .. end] (inclusive); equal ones share the rank of the first, or, with tails,
    are ordered by them. Equal symbols up to an end must mean equal ends (true if symbols carry the L/S types)."""
    n = len(starts)
    rank = np.zeros(n, np.int64)
    active, per, j = np.arange(n), max(1, 62 // bits), 0
    while len(active):
        key = np.zeros(len(active), np.int64)
        for k in range(j, j + per):
            at = starts[active] + k
            inside = at <= ends[active]
            key = (key << bits) | np.where(inside, symbols[np.minimum(at, len(symbols) - 1)] + 1, 0)
        j += per
        rank[active], order, same = _split(rank[active], key)
        active = active[order][same]
        over = starts[active] + j > ends[active]
        if over.any():
            if tails is not None:
                rank[active[over]], _, _ = _split(rank[active[over]], tails[active[over]])
            active = active[~over]
    return rank


def _split(rank: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks refined by key; the sorted order, and which of its places still share their rank with another."""
    order = np.lexsort((key, rank)) if rank.any() else np.argsort(key, kind="stable")
    r, k = rank[order], key[order]
    place = np.arange(len(r))
    old, new = np.ones(len(r), bool), np.ones(len(r), bool)
    old[1:] = r[1:] != r[:-1]
    new[1:] = old[1:] | (k[1:] != k[:-1])
    r = r + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(old, place, 0))
    last = np.append(new[1:], True)
    out = np.empty(len(r), np.int64)
    out[order] = r
    return out, order, ~(new & last)


def _sorted_lms(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The LMS positions in the order of their suffixes."""
    typed = s.astype(np.int64) * 2 + smaller
    ends = np.append(lms[1:], lms[-1])
    names = _refine(typed, int(typed.max() + 1).bit_length(), lms, ends)
    distinct, names = np.unique(names, return_inverse=True)
    if len(distinct) == len(lms):
        return lms[np.argsort(names, kind="stable")]
    return lms[_recurse(names)]


def _recurse(s: np.ndarray) -> np.ndarray:
    """The suffix array of a string of names, whose last symbol is its least and occurs once."""
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable")
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(lms):
        return np.argsort(s, kind="stable")
    order = _sorted_lms(s, smaller, lms)
    lms_rank = np.empty(n, np.int64)
    lms_rank[order] = np.arange(len(order))
    typed = s.astype(np.int64) * 2 + smaller
    at = np.searchsorted(lms, np.arange(n), "right")  # the next LMS position after each
    ends = np.append(lms, n - 1)[at]
    rank = _refine(typed, int(typed.max() + 1).bit_length(), np.arange(n), ends, np.where(at < len(lms), lms_rank[ends], -1))
    return np.argsort(rank, kind="stable")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. s: small non-negative integers; the last is the only 0."""
    n = len(s)
    s = s.astype(np.uint16)
    if n < 2:
        return np.arange(n)
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = _sorted_lms(s, smaller, lms)
    size = np.bincount(s)
    bounds = np.concatenate([[0], np.cumsum(size)])
    out = np.full(n, -1, np.int32)

    def place(at: np.ndarray, fill: np.ndarray, sign: int) -> None:
        """Append positions to their buckets, in order; fill: the buckets' next free places."""
        c = s[at]
        by = np.argsort(c, kind="stable")
        c = c[by].astype(np.int64)
        first = np.ones(len(c), bool)
        first[1:] = c[1:] != c[:-1]
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(c)))
        within = np.arange(len(c)) - np.repeat(starts, counts)
        out[fill[c] + sign * within] = at[by]
        fill[c[starts]] += sign * counts

    lms_of = np.searchsorted(s[order], np.arange(len(size) + 1))  # LMS suffixes by first symbol: they are in order
    head = bounds[:-1].copy()
    for c in range(len(size)):
        done = bounds[c]
        while done < head[c]:
            batch = out[done : head[c]]
            done = head[c]
            before = batch[batch > 0] - 1
            if len(before := before[~smaller[before]]):
                place(before, head, 1)
        before = order[lms_of[c] : lms_of[c + 1]] - 1
        if len(before := before[before >= 0]):
            if len(before := before[~smaller[before]]):
                place(before, head, 1)
    tail = bounds[1:] - 1
    larger_end = head  # end of each bucket's L part
    for c in range(len(size) - 1, 0, -1):
        done = bounds[c + 1] - 1
        while done > tail[c]:
            batch = out[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            before = batch[batch > 0] - 1
            if len(before := before[smaller[before]]):
                place(before, tail, -1)
        batch = out[bounds[c] : larger_end[c]][::-1]
        before = batch[batch > 0] - 1
        if len(before := before[smaller[before]]):
            place(before, tail, -1)
    out[0] = n - 1
    return out


def common_prefixes(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """LCP of each suffix with its predecessor in `order` (0 for the first), cut off at `most`.

    Permuted: a suffix at i whose predecessor continues the one at i - 1 has that one's length less one; only the
    others (irreducible) are compared."""
    n = len(s)
    phi = np.full(n, -1, np.int32)
    phi[order[1:]] = order[:-1]
    at = np.arange(n, dtype=np.int32)
    # the cut-off makes "less one" wrong for values of `most`: compare further by the longest stretch that can follow
    reducible = np.zeros(n, bool)
    reducible[1:] = (phi[1:] > 0) & (phi[:-1] == phi[1:] - 1) & (s[:-1] == s[np.maximum(phi[1:] - 1, 0)])
    reducible &= at % most != 0
    need = np.flatnonzero(~reducible & (phi >= 0))
    length = np.zeros(n, np.int32)
    i, k, active = need, phi[need], need
    d = 0
    while len(active) and d < 2 * most:
        same = (np.maximum(i, k) + d < n) & (s[np.minimum(i + d, n - 1)] == s[np.minimum(k + d, n - 1)])
        length[active[same]] = d + 1
        active, i, k = active[same], i[same], k[same]
        d += 1
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    plcp = np.minimum(np.maximum(length[source] - (at - source), 0), most)
    return plcp[order]


def symbol_suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, for an alphabet that may be as large as the string. s: non-negative integers
    without gaps; the last is the only 0."""
    return _recurse(s.astype(np.int64))


def whole_common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By position: the length of the common prefix of a suffix with its predecessor in `order`, not cut off.

    Permuted: where the predecessor is preceded by the same symbol as the suffix, the length is that of the position
    before less one; only the others are compared, together while they are many, then each by itself."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    at = np.arange(n)
    reducible = np.zeros(n, bool)
    reducible[1:] = (phi[1:] > 0) & (s[:-1] == s[np.maximum(phi[1:] - 1, 0)])
    active = np.flatnonzero(~reducible & (phi >= 0))
    length = np.zeros(n, np.int64)
    d = 0
    while len(active) > 64:
        other = phi[active]
        same = np.maximum(active, other) + d < n
        same[same] = s[active[same] + d] == s[other[same] + d]
        active = active[same]
        length[active] = d = d + 1
    for i in active.tolist():
        k, at_once = int(phi[i]), 64
        size = int(length[i])
        while (most := min(at_once, n - max(i, k) - size)) > 0:
            differ = np.flatnonzero(s[i + size : i + size + most] != s[k + size : k + size + most])
            if len(differ):
                size += int(differ[0])
                break
            size, at_once = size + most, at_once * 2
        length[i] = size
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    return length[source] - (at - source)
