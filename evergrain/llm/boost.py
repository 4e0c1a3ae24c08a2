"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Level-wise trees of fixed depth; a tree is a full binary heap of (feature, bin), its leaves hold log-odds."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1).astype(np.int64)

    def _edges(self, x: np.ndarray) -> np.ndarray:
        """Between all values if they are few (a rare flag must keep its edge), else quantiles."""
        values = np.unique(x)
        if len(values) <= self.bins:
            return (values[1:] + values[:-1]) / 2
        return np.unique(np.quantile(x, np.linspace(0, 1, self.bins + 1)[1:-1], method="higher"))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [self._edges(x[:, k]) for k in range(x.shape[1])]
        b, (n, width), bins = self._binned(x), x.shape, self.bins + 1
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        f = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, bins)
            at = np.zeros(n, int)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                key = (at - first) * bins
                best = np.full(count, 1e-9)
                for k in range(width):
                    gs = np.bincount(key + b[:, k], g, count * bins).reshape(count, bins).cumsum(1)
                    hs = np.bincount(key + b[:, k], h, count * bins).reshape(count, bins).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < self.least) | (ht - hl < self.least)] = -1
                    top = gain.argmax(1)
                    new = np.flatnonzero(gain[np.arange(count), top] > best)
                    best[new] = gain[new, top[new]]
                    feature[first + new], cut[first + new] = k, top[new] + 1
                at = 2 * at + 1 + (b[np.arange(n), feature[at]] >= cut[at])
            leaf = at - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            self.nodes.append((feature, cut, value))
            f += value[leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        f = np.full(len(x), self.base)
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] >= cut[at])
            f += value[at - (2**self.depth - 1)]
        return f
