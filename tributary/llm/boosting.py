"""Gradient-boosted trees for a binary label over small whole-number features, with calibrated thresholds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """For each tree the feature and split of its inner nodes (heap order) and the values of its leaves."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, s, v in zip(self.feature, self.split, self.value):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > s[node])
            total += v[node - (2**self.depth - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Newton boosting on the log loss; features are clipped to 0 .. BINS-1."""
    x = np.clip(x, 0, BINS - 1).astype(int)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    total, inner, n = np.full(len(y), base), 2**depth - 1, x.shape[1]
    features, splits, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node, f, s = np.zeros(len(y), int), np.zeros(inner, int), np.full(inner, BINS)
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            best = 1e-6
            if len(mine):
                g, h = grad[mine], hess[mine]
                whole = g.sum() ** 2 / (h.sum() + ridge)
                for j in range(n):
                    gl, hl = (np.cumsum(np.bincount(x[mine, j], w, BINS))[:-1] for w in (g, h))
                    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - whole
                    if gain.max() > best:
                        best, f[k], s[k] = gain.max(), j, int(gain.argmax())
                node[mine] = 2 * k + 1 + (x[mine, f[k]] > s[k])
        leaf = node - inner
        v = rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + ridge)
        total += v[leaf]
        features.append(f), splits.append(s), values.append(v)
    return Trees(np.array(features), np.array(splits), np.array(values), base, depth)


def threshold(p: np.ndarray, y: np.ndarray, precision: float, floor: float = 0.5) -> float:
    """The lowest probability from which held-out rows are right at least this often; above 1 where none is."""
    order = np.argsort(-p)
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    return max(floor, float(p[order][good[-1]])) if len(good) else 1.1
