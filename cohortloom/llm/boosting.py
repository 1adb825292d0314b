"""Gradient-boosted trees for a yes/no label, fitted on a bounded matrix of binned features."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

MOST_ROWS = 200_000


class Tree(NamedTuple):
    """A complete tree, level by level: split feature and bin per node, value per leaf."""

    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray


class Boosted(NamedTuple):
    """``edges``: bin borders per feature; a sample's score is ``base`` plus its leaves."""

    edges: list[np.ndarray]
    base: float
    trees: list[Tree]

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(e, x[:, j], "right")
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of yes."""
        bins = self.binned(np.asarray(x, float))
        rows = np.arange(len(bins))
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            node = np.zeros(len(bins), np.int64)
            depth = (len(tree.leaf) - 1).bit_length()
            for _ in range(depth):
                node = 2 * node + 1 + (bins[rows, tree.feature[node]] > tree.bin[node])
            out += tree.leaf[node - len(tree.feature)]
        return out


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0
) -> Boosted:
    """Logistic loss, second-order leaf values, best split per node over all binned features."""
    if len(x) > MOST_ROWS:
        raise ValueError(f"the fit takes at most {MOST_ROWS} rows")
    x, y = np.asarray(x, float), np.asarray(y, float)
    probs = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], probs)) for j in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(edges, float(np.log(share / (1 - share))), [])
    binned = model.binned(x).astype(np.int64)
    n, k = x.shape
    score = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        inner = (1 << depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 1 << level
            local = node - (width - 1)
            best = np.zeros(width)
            for j in range(k):
                size = len(edges[j]) + 1
                slot = local * size + binned[:, j]
                g = np.bincount(slot, grad, width * size).reshape(width, size).cumsum(1)
                h = np.bincount(slot, hess, width * size).reshape(width, size).cumsum(1)
                gr, hr = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + ridge) + gr**2 / (hr + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                at = gain.argmax(1)
                found = gain[np.arange(width), at]
                better = np.flatnonzero(found > best + 1e-9)
                best[better] = found[better]
                feature[width - 1 + better], cut[width - 1 + better] = j, at[better]
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        g = np.bincount(leaf, grad, 1 << depth)
        h = np.bincount(leaf, hess, 1 << depth)
        value = rate * g / (h + ridge)
        model.trees.append(Tree(feature, cut, value))
        score += value[leaf]
    return model
