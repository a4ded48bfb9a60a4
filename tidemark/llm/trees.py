"""A small gradient-boosted tree classifier on numpy arrays: logistic loss, quantile bins, fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Trees of one depth in heap order: split feature and threshold of inner nodes, values of leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1])) if self.value.size else 0
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Fit on a sample that fits in memory; without two classes the score is constant."""
    n, width = x.shape
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if n == 0 or y.min() == y.max():
        return Boosted(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    code = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])  # x > e[b] when code > b
    flat = code + np.arange(width) * bins
    score = np.full(n, base)
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        f, c = np.zeros(inner, int), np.full(inner, np.inf)
        for node in range(inner):
            own = at == node
            if own.sum() >= 4:
                gs = np.bincount(flat[own].reshape(-1), np.repeat(g[own], width), minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(flat[own].reshape(-1), np.repeat(h[own], width), minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge)
                best = int(gain[:, :-1].argmax())
                j, b = divmod(best, bins - 1)
                if b < len(edges[j]) and gain[j, b] > gt * gt / (ht + ridge) + 1e-9:
                    f[node], c[node] = j, edges[j][b]
            at[own] = 2 * node + 1 + (x[own, f[node]] > c[node])
        leaf = at - inner
        v = rate * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + ridge)
        score = score + v[leaf]
        features.append(f), cuts.append(c), values.append(v)
    return Boosted(np.array(features), np.array(cuts), np.array(values), base)
