"""Gradient-boosted regression trees for a 0/1 label, in numpy: histograms over binned features, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    start: float
    features: np.ndarray  #: (trees, inner nodes)
    cuts: np.ndarray  #: (trees, inner nodes): go right above it
    leaves: np.ndarray  #: (trees, leaves)
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += leaf[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, ridge: float = 1.0) -> Trees:
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    mean = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    total = np.full(n, start)
    inner, size = 2**depth - 1, 2**depth
    features, cuts, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, size))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            own = at - first
            best, best_gain = [(0, np.inf)] * count, np.zeros(count)
            for k in range(m):
                cell = own * BINS + binned[:, k]
                gs = np.bincount(cell, g, count * BINS).reshape(count, BINS).cumsum(axis=1)
                hs = np.bincount(cell, h, count * BINS).reshape(count, BINS).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[:, len(edges[k]) :] = -1
                top = gain.argmax(axis=1)
                for node in np.flatnonzero(gain[np.arange(count), top] > best_gain + 1e-6):
                    best_gain[node], best[node] = gain[node, top[node]], (k, edges[k][top[node]])
            for node, (k, cut) in enumerate(best):
                features[t, first + node], cuts[t, first + node] = k, cut
            f, c = features[t, at], cuts[t, at]
            at = 2 * at + 1 + (x[np.arange(n), f] > c)
        leaf = at - inner
        leaves[t] = -rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + ridge)
        total += leaves[t][leaf]
    return Trees(start, features, cuts, leaves, depth)
