"""BagMinHash: signatures whose agreement estimates the weighted (multiset) Jaccard similarity without bias.

An element of count w stands for the weight levels 1 .. w. The levels are cut into the dyadic blocks (0, 1], (1, 2],
(2, 4], (4, 8], ...; each block of each element carries a Poisson process whose rate is its length, and an element takes
part in a block's process only with the levels up to its count. A process that covers several levels is hierarchical:
after its first point it is split in halves, one of which (by a fair bit) inherits the point while the other starts
afresh at the point's time; halves above the count are dropped, so a large count costs its logarithm. Every point falls
on one of the m components; a component keeps its earliest point's identity. All choices hash the element and the level,
so equal levels of equal elements make equal points in every document.

A document's processes stop once their next point is later than all m components' current points; therefore the work is
in proportion to the elements plus m log m, not their product. A block of documents is processed together, a round of
all running processes at a time.
"""

from __future__ import annotations

import numpy as np

from .common import U64, mix

_STEP = U64(0x9E3779B97F4A7C15)
_FRESH = U64(0xD1B54A32D192ED03)


def _exponential(seed: np.ndarray) -> np.ndarray:
    return -np.log(((seed >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def signatures(row: np.ndarray, element: np.ndarray, count: np.ndarray, rows: int, m: int) -> np.ndarray:
    """(rows, m) identities (uint64) of each component's earliest point; 0 in rows without elements.

    row, element, count: the distinct elements (64-bit hashes) of each document and how often it holds them."""
    earliest = np.full(rows * m, np.inf)
    identity = np.zeros(rows * m, U64)
    # one process per element and dyadic block that begins below its count
    blocks = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    of = np.repeat(np.arange(len(row)), blocks)
    b = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(b > 0, np.int64(1) << np.maximum(b - 1, 0), 0)
    size = np.where(b > 0, low, 1)
    r, w = row[of], count[of]
    # the seed of a process names its element and levels; counter numbers the points of a single level
    seed = mix(element[of] + _STEP * (low * 2 + 1).astype(U64) + _FRESH * size.astype(U64))
    time = _exponential(seed) / size
    told = np.zeros(len(r), bool)
    limit = np.full(rows, np.inf)
    element = element[of]
    point = seed
    while len(r):
        full = (low + size <= w) & ~told
        if full.any():
            cell = r[full] * m + (mix(point[full] ^ _FRESH) % U64(m)).astype(np.int64)
            np.minimum.at(earliest, cell, time[full])
            won = earliest[cell] == time[full]
            identity[cell[won]] = point[full][won]
            touched = np.unique(r[full])
            limit[touched] = earliest.reshape(rows, m)[touched].max(1)
        told |= full
        whole = size > 1
        # single levels: the next point
        one = ~whole
        next_point = mix(point[one] + _STEP)
        parts = [(r[one], element[one], low[one], size[one], w[one], time[one] + _exponential(next_point), next_point, np.zeros(int(one.sum()), bool))]
        if whole.any():
            half = size[whole] // 2
            upper = ((point[whole] >> U64(5)) & U64(1)).astype(bool)  # which half inherits the point
            heir = low[whole] + np.where(upper, half, 0)
            other = low[whole] + np.where(upper, 0, half)
            fresh = mix(element[whole] + _STEP * (other * 2 + 1).astype(U64) + _FRESH * half.astype(U64))
            parts.append((r[whole], element[whole], heir, half, w[whole], time[whole], point[whole], told[whole]))
            parts.append((r[whole], element[whole], other, half, w[whole], time[whole] + _exponential(fresh) / half, fresh, np.zeros(len(half), bool)))
        r, element, low, size, w, time, point, told = (np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]
        go = (time <= limit[r]) & (low < w)
        if not go.all():
            r, element, low, size, w, time, point, told = (x[go] for x in (r, element, low, size, w, time, point, told))
    return identity.reshape(rows, m)
