"""Gradient-boosted trees on small dense samples, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic boosting of complete binary trees on binned features, by Newton steps."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        raw = np.full(n, self.base)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                place = node - first
                best = np.zeros(count)
                for f in range(width):
                    if not len(cuts[f]):
                        continue
                    key = place * self.bins + binned[:, f]
                    g = np.bincount(key, grad, count * self.bins).reshape(count, -1).cumsum(axis=1)
                    h = np.bincount(key, hess, count * self.bins).reshape(count, -1).cumsum(axis=1)
                    gl, hl, g_all, h_all = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (g_all - gl) ** 2 / (h_all - hl + self.ridge) - g_all**2 / (h_all + self.ridge)
                    gain[(hl < self.least) | (h_all - hl < self.least)] = 0
                    gain[:, len(cuts[f]) :] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(count), at]
                    better = top > best + 1e-9
                    best = np.where(better, top, best)
                    for k in np.flatnonzero(better):
                        feature[first + k], cut[first + k] = f, cuts[f][at[k]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - inner
            g = np.bincount(leaf, grad, inner + 1)
            h = np.bincount(leaf, hess, inner + 1)
            values = self.rate * g / (h + self.ridge)
            raw += values[leaf]
            self.trees.append((feature, cut, values))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = 2**self.depth - 1
        for feature, cut, values in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += values[node - inner]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best rising fit of y on score by pooling adjacent violators: knots for linear interpolation. Each
    pool starts from half a row of either class, so no estimate is quite 0 or 1."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, sum of score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1.0, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    table = np.array(pools)
    rising = np.maximum.accumulate((table[:, 0] + 0.5 * y.mean()) / (table[:, 1] + 0.5))
    return table[:, 2] / table[:, 1], rising
