"""Gradient-boosted trees for a binary label: histogram splits, second-order logistic loss, complete trees."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], q)) for j in range(d)]
        b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p0 / (1 - p0)))
        f = np.full(n, self.base)
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.value = np.zeros((self.trees, inner + 1))
        offset = np.arange(d) * self.bins
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows):
                        self._split(t, k, b[rows] + offset, g[rows], h[rows], d)
                j, c = self.feature[t, node], self.cut[t, node]
                node = 2 * node + 1 + (x[np.arange(n), j] > c)
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            self.value[t] = -self.rate * gs / (hs + self.l2)
            f += self.value[t, leaf]
        return self

    def _split(self, t: int, k: int, b: np.ndarray, g: np.ndarray, h: np.ndarray, d: int) -> None:
        size = d * self.bins
        gs = np.bincount(b.ravel(), np.repeat(g, d), size).reshape(d, self.bins).cumsum(axis=1)
        hs = np.bincount(b.ravel(), np.repeat(h, d), size).reshape(d, self.bins).cumsum(axis=1)
        g_all, h_all = gs[0, -1], hs[0, -1]
        gain = gs**2 / (hs + self.l2) + (g_all - gs) ** 2 / (h_all - hs + self.l2) - g_all**2 / (h_all + self.l2)
        gain[(hs < self.least) | (h_all - hs < self.least)] = 0
        j, at = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[j, at] > 1e-9 and at < len(self.cuts[j]):
            self.feature[t, k], self.cut[t, k] = j, self.cuts[j][at]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        n, d = x.shape
        flat, at, inner = np.ascontiguousarray(x).ravel(), np.arange(n) * d, 2**self.depth - 1
        out = np.full(n, self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(n, np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (flat[at + feature[node]] > cut[node])
            out += value[node - inner]
        return out
