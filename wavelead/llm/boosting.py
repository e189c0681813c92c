"""Histogram gradient-boosted trees for two classes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees as flat arrays: the children of node k are 2k + 1 and 2k + 2.

    ``feature`` and ``threshold`` are (trees, inner nodes), ``leaf`` is (trees,
    leaves). A value above the threshold goes right; NaN goes left. Nodes that
    are not split have an infinite threshold.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = (self.feature.shape[1] + 1).bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    smooth: float = 1.0,
    least: float = 1e-3,
) -> Forest:
    """Trees on the second-order expansion of the log loss, split at the bounds of ``bins`` quantile bins.

    Without rows, or with rows of one class only, the forest is a constant.
    """
    n, width = x.shape
    rate_of_ones = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    inner = 2**depth - 1
    shape = (trees if 0 < y.sum() < n else 0, inner)
    forest = Forest(base, np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros((shape[0], inner + 1)))
    if not shape[0]:
        return forest
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(n, base)
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            place = node - first
            best, where = np.full(count, 1e-6), np.full((count, 2), -1)
            for f in range(width):
                cell = place * bins + binned[:, f]
                g = np.bincount(cell, gradient, count * bins).reshape(count, bins)
                h = np.bincount(cell, weight, count * bins).reshape(count, bins)
                gl, hl = g.cumsum(axis=1), h.cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gr, hr = gt - gl, ht - hl
                gain = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - gt**2 / (ht + smooth)
                gain[(hl < least) | (hr < least)] = 0
                gain = gain[:, : len(cuts[f])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(axis=1)
                value = gain[np.arange(count), k]
                better = value > best
                best[better] = value[better]
                where[better] = np.stack([np.full(count, f), k], axis=1)[better]
            for k, (f, b) in enumerate(where.tolist()):
                if f >= 0:
                    feature[first + k], threshold[first + k] = f, cuts[f][b]
            rows = np.arange(n)
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        at = node - inner
        g, h = np.bincount(at, gradient, inner + 1), np.bincount(at, weight, inner + 1)
        leaf[:] = -rate * g / (h + smooth)
        margin += leaf[at]
    return forest
