"""Gradient-boosted trees on small integer features, and calibration of their scores."""

from __future__ import annotations

import numpy as np


class Trees:
    """Boosted regression trees for a two-class log-loss, on features binned by quantiles."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 16, least: int = 5, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list = []
            self._grow(tree, b, y - p, p * (1 - p) + 1e-6, np.arange(len(y)), 0)
            self.trees.append(tree)
            score += self._apply(tree, b)
        # Platt scaling on the raw score keeps the probabilities honest.
        self.scale, self.shift = 1.0, 0.0
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 100, prior: float = 1.0) -> "Trees":
        """Platt scaling on held-out rows; a prior keeps scale and shift near 1 and 0, also where the classes part cleanly."""
        s, a, c = np.clip(self.raw(x), -30, 30), 1.0, 0.0
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * s + c, -30, 30)))
            w, g = p * (1 - p), p - t
            h = np.array([[np.sum(w * s * s) + prior, np.sum(w * s)], [np.sum(w * s), np.sum(w) + prior]])
            d = np.clip(np.linalg.solve(h, [np.sum(g * s) + prior * (a - 1), np.sum(g) + prior * c]), -0.5, 0.5)
            a, c = a - d[0], c - d[1]
            if abs(d).max() < 1e-6:
                break
        if np.isfinite([a, c]).all() and a > 0:
            self.scale, self.shift = float(a), float(c)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def _grow(self, tree: list, b, g, h, rows, depth) -> int:
        at = len(tree)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        tree.append([-1, 0, 0, 0, self.rate * total_g / (total_h + self.ridge)])
        if depth == self.depth or len(rows) < 2 * self.least:
            return at
        best = (1e-6, -1, 0)
        for f in range(b.shape[1]):
            n = len(self.edges[f]) + 1
            if n < 2:
                continue
            v = b[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(v, w, n)) for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + self.ridge) + (total_g - gs) ** 2 / (total_h - hs + self.ridge) - total_g**2 / (total_h + self.ridge)
            gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] < 0:
            return at
        left = b[rows, best[1]] <= best[2]
        tree[at][0], tree[at][1] = best[1], best[2]
        tree[at][2] = self._grow(tree, b, g, h, rows[left], depth + 1)
        tree[at][3] = self._grow(tree, b, g, h, rows[~left], depth + 1)
        return at

    def _apply(self, tree: list, b: np.ndarray) -> np.ndarray:
        t = np.array([n[:4] for n in tree])
        value = np.array([n[4] for n in tree])
        at = np.zeros(len(b), int)
        for _ in range(self.depth):
            f = t[at, 0]
            inner = f >= 0
            low = b[np.arange(len(b)), np.maximum(f, 0)] <= t[at, 1]
            at = np.where(inner, np.where(low, t[at, 2], t[at, 3]), at)
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(np.asarray(x))
        return self.base + sum(self._apply(t, b) for t in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -50, 50)))
