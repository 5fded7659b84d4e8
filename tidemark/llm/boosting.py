"""Gradient-boosted regression trees for two classes, over binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: node n has the children 2n+1 and 2n+2; a split sends ``x > cut`` to the second."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    bias: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        out = np.full(len(x), self.bias)
        row = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            out += leaf[node - inner] if len(x) else 0.0
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, smooth: float = 1.0, least: int = 5) -> Trees:
    """Newton boosting of the logistic loss; splits are sought between quantiles of each feature."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = (y.sum() + 1) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(n, bias)
    all_f, all_c, all_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = node - first
            gain = np.full(count, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key, k = at * (bins + 1) + binned[:, f], count * (bins + 1)
                gs = np.bincount(key, g, k).reshape(count, -1).cumsum(1)
                hs = np.bincount(key, h, k).reshape(count, -1).cumsum(1)
                ns = np.bincount(key, minlength=k).reshape(count, -1).cumsum(1)
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                better = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
                better[(ns < least) | (nt - ns < least)] = -1
                better = better[:, : len(e)]
                top = better.argmax(1)
                value = better[np.arange(count), top]
                won = value > gain
                gain[won] = value[won]
                feature[first : first + count][won] = f
                cut[first : first + count][won] = e[top[won]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + smooth)
        margin += leaf[at]
        all_f.append(feature)
        all_c.append(cut)
        all_l.append(leaf)
    return Trees(np.array(all_f), np.array(all_c), np.array(all_l), bias)
