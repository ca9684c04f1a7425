"""Gradient-boosted trees on small tables: logistic loss, histogram splits, NumPy only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth, as arrays: at an inner node go right if feature > threshold."""

    base: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    #: Platt scaling of the margin, fitted on rows that the trees have not seen.
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0, bins: int = 32) -> Trees:
    p0 = np.clip(y.mean(), 0.01, 0.99)
    trees = Trees(float(np.log(p0 / (1 - p0))), depth)
    cuts = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    margin = np.full(len(x), trees.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        inner = 2**depth - 1
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            best = 1e-9
            for f, c in enumerate(cuts):
                if not len(at) or not len(c):
                    continue
                gs = np.cumsum(np.bincount(binned[at, f], g[at], len(c) + 1))
                hs = np.cumsum(np.bincount(binned[at, f], h[at], len(c) + 1))
                gain = gs[:-1] ** 2 / (hs[:-1] + l2) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + l2) - gs[-1] ** 2 / (hs[-1] + l2)
                if gain.max() > best:
                    best, feature[k], threshold[k] = gain.max(), f, c[gain.argmax()]
            node[at] = 2 * k + 1 + (x[at, feature[k]] > threshold[k])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        margin += value[leaf]
        trees.feature.append(feature)
        trees.threshold.append(threshold)
        trees.value.append(value)
    return trees


def calibrate(trees: Trees, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Trees:
    """Platt scaling by Newton steps on rows held out from boost()."""
    m = trees.margin(x)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w, e = np.maximum(p * (1 - p), 1e-6), p - y
        g = np.array([(e * m).sum() + 0.1 * (a - 1), e.sum() + 0.1 * b])
        hess = np.array([[(w * m * m).sum() + 0.1, (w * m).sum()], [(w * m).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    trees.scale, trees.shift = float(max(a, 0.05)), float(b)
    return trees
