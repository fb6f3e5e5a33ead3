"""Histogram gradient-boosted trees for a binary label, in numpy.

Features are cut into at most 64 quantile bins; each tree grows level by level
from histograms of first and second derivatives of the log loss.  A fitted
model is five flat arrays (feature, threshold, left child, value, root), which
a batch of rows walks together, one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FlatTrees:
    feature: np.ndarray  # int16; -1 at a leaf
    threshold: np.ndarray  # float64; go right when above
    left: np.ndarray  # int32; the right child follows it
    value: np.ndarray  # float64, of leaves
    roots: np.ndarray  # int32
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                f = self.feature[node]
                right = x[rows, np.maximum(f, 0)] > self.threshold[node]
                node = np.where(f < 0, node, self.left[node] + right)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 8) -> FlatTrees:
    """Fit on rows of finite features; one class only gives a constant score."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1.0) if n else 0.5
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1) if width else np.zeros((n, 0), int)
    score = np.full(n, base)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    offsets = np.arange(width) * bins
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        roots.append(node())
        front = [(roots[-1], np.arange(n))]
        for level in range(depth + 1):
            following = []
            for at, rows in front:
                g, h = grad[rows].sum(), hess[rows].sum()
                best = None
                if level < depth and len(rows) >= 2 * least:
                    flat = (binned[rows] + offsets).ravel()
                    size = width * bins
                    hg = np.bincount(flat, np.repeat(grad[rows], width), size).reshape(width, bins).cumsum(1)
                    hh = np.bincount(flat, np.repeat(hess[rows], width), size).reshape(width, bins).cumsum(1)
                    hn = np.bincount(flat, minlength=size).reshape(width, bins).cumsum(1)
                    gain = hg**2 / (hh + ridge) + (g - hg) ** 2 / (h - hh + ridge) - g**2 / (h + ridge)
                    gain[(hn < least) | (len(rows) - hn < least)] = 0
                    k = int(gain.argmax())
                    if gain.flat[k] > 1e-6:
                        best = divmod(k, bins)
                if best is None:
                    value[at] = rate * float(g / (h + ridge))
                    score[rows] += value[at]
                    continue
                f, b = best
                low = node()
                node()
                feature[at], threshold[at], left[at] = f, float(cuts[f][b]), low
                goes = binned[rows, f] > b
                following += [(low, rows[~goes]), (low + 1, rows[goes])]
            front = following
    return FlatTrees(np.array(feature, np.int16), np.array(threshold, float), np.array(left, np.int32), np.array(value, float), np.array(roots, np.int32), base, depth)
