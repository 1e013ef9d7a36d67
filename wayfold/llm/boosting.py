"""Gradient-boosted trees for the logistic loss, on numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of a fixed depth over binned features; ``probability`` is calibrated by ``calibrate``."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scale = (1.0, 0.0)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:])) for k in range(x.shape[1])]
        b, f = self._binned(x), np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.start, width = float(f[0]), self.bins + 2
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            split_on, split_at = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, width)
            for level in range(self.depth):
                n, first = 2**level, 2**level - 1
                best = np.full(n, 1e-6)
                for k in range(b.shape[1]):
                    cell = (node - first) * width + b[:, k]
                    gs = np.bincount(cell, g, n * width).reshape(n, width).cumsum(1)
                    hs = np.bincount(cell, h, n * width).reshape(n, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    at = gain.argmax(1)
                    top = gain[np.arange(n), at]
                    better = top > best
                    best[better] = top[better]
                    split_on[first : first + n][better] = k
                    split_at[first : first + n][better] = at[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), split_on[node]] > split_at[node])
            leaf = node - (2**self.depth - 1)
            gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            value = self.rate * gs / (hs + self.ridge)
            self.trees.append((split_on, split_at, value))
            f += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = self._binned(x), np.full(len(x), self.start), np.arange(len(x))
        for split_on, split_at, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, split_on[node]] > split_at[node])
            f += value[node - (2**self.depth - 1)]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> None:
        """Platt scaling on rows that the trees haven't seen."""
        m, (a, c) = self.margin(x), self.scale
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * m + c)))
            w = np.maximum(p * (1 - p), 1e-9)
            grad = np.array([((p - y) * m).sum() + 0.1 * (a - 1), (p - y).sum()])
            hess = np.array([[(w * m * m).sum() + 0.1, (w * m).sum()], [(w * m).sum(), w.sum() + 0.1]])
            step = np.linalg.solve(hess, grad)
            a, c = a - step[0], c - step[1]
            if abs(step).max() < 1e-9:
                break
        self.scale = (float(a), float(c))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * self.margin(x) + self.scale[1])))
