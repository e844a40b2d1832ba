"""Histogram gradient-boosted trees for two classes, in numpy.

Features are binned by quantiles once; a tree grows level by level from histograms of gradients;
all trees are flattened into arrays, and rows go down all of them together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Nodes of all trees in one heap order: node i of a tree has children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes; -1: every row goes left
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row of x; not-a-number goes left."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while len(at) and at[0] < inner:
                which = f[at]
                at = 2 * at + 1 + ((which >= 0) & (x[rows, np.maximum(which, 0)] > t[at]))
            out += v[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1, rounded to 9 digits."""
        return np.round(1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -35, 35))), 9)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Boosts logistic loss. Rows of one label only (or none) give that label's share as a constant."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    n, m = x.shape if x.ndim == 2 else (0, 0)
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if n else 0.5
    inner, base = 2**depth - 1, float(np.log(share / (1 - share)))
    none = Trees(np.full((0, inner), -1), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if not n or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(n, base)
    fs, ts, vs = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, at = np.full(inner, -1), np.zeros(inner), np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            best, where, cut = np.full(nodes, 1e-6), np.full(nodes, -1), np.zeros(nodes, dtype=np.int64)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                width = len(cuts[j]) + 1
                key = local * width + binned[:, j]
                gs = np.bincount(key, g, nodes * width).reshape(nodes, width)
                hs = np.bincount(key, h, nodes * width).reshape(nodes, width)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                better = top > best
                best[better], where[better], cut[better] = top[better], j, k[better]
            for i in range(nodes):
                if where[i] >= 0:
                    feature[first + i], threshold[first + i] = where[i], cuts[where[i]][cut[i]]
            which = where[local]
            at = 2 * at + 1 + ((which >= 0) & (binned[np.arange(n), np.maximum(which, 0)] > cut[local]))
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        fs.append(feature), ts.append(threshold), vs.append(value)
    return Trees(np.array(fs), np.array(ts), np.array(vs), base)


def auc(y: np.ndarray, s: np.ndarray) -> float:
    """The area under the ROC curve; ties count half."""
    y, s = np.asarray(y), np.asarray(s)
    _, inverse, count = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    pos = int(y.sum())
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / max(1, pos * (len(y) - pos)))
