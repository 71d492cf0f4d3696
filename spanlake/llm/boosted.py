"""Gradient-boosted trees for two classes: histograms of binned features, second-order gains, trees of one depth."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: ``feature`` and ``threshold`` per tree and inner node, ``leaf`` per tree and leaf, all as arrays."""

    feature: object
    threshold: object
    leaf: object
    base: float

    def log_odds(self, x):
        """Log odds of class 1 for every row of the matrix ``x``; a value above the threshold goes right."""
        import numpy as np
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = (self.feature.shape[1] + 1).bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out


def fit_trees(x, y, weight, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 4.0, least: float = 4.0) -> Trees:
    """Boosted trees for labels ``y`` (0, 1) by rows of ``x`` with ``weight``; the same input gives the same trees.

    Every split maximises the second-order gain of the logistic loss over at most ``bins`` - 1 thresholds a feature (quantiles); a side
    needs a sum of second derivatives of ``least``.
    """
    import numpy as np
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) + np.arange(width) * bins
    base = float(np.log(((y * weight).sum() + 1) / (((1 - y) * weight).sum() + 1)))
    score, inner = np.full(n, base), 2 ** depth - 1
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2 ** level - 1, 2 ** level
            place = ((at - first)[:, None] * (width * bins) + binned).ravel()
            sums = [np.bincount(place, np.repeat(v, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2) for v in (g, h)]
            left, all_ = [s[:, :, :-1] for s in sums], [s[:, :, -1:] for s in sums]
            right = [a - b for a, b in zip(all_, left)]
            value = lambda s: s[0] ** 2 / (s[1] + ridge)
            gain = np.where((left[1] >= least) & (right[1] >= least), value(left) + value(right) - value(all_), 0.0)
            best = gain.reshape(many, -1).argmax(axis=1)
            feature, cut = best // (bins - 1), best % (bins - 1)
            for k in range(many):
                if gain[k, feature[k], cut[k]] > 1e-6 and cut[k] < len(cuts[feature[k]]):
                    features[t, first + k], thresholds[t, first + k] = feature[k], cuts[feature[k]][cut[k]]
            at = 2 * at + 1 + (x[np.arange(n), features[t, at]] > thresholds[t, at])
        sums = [np.bincount(at - inner, v, inner + 1) for v in (g, h)]
        leaves[t] = rate * sums[0] / (sums[1] + ridge)
        score += leaves[t, at - inner]
    return Trees(features, thresholds, leaves, base)
