"""Gradient-boosted trees for a 0/1 label, with isotonic calibration; plain arrays in and out."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of depth-limited trees over quantile bins. A model is a few arrays, so it can be sent to workers."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 8):
        self.n_trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0
        self.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1) if x.shape[1] else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.trees = []
        p = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        if not len(y) or y.min() == y.max():
            return self
        b, f = self._binned(x), np.full(len(y), self.start)
        flat = b + np.arange(b.shape[1]) * self.bins
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-f))
            tree, leaf = self._tree(b, flat, p - y, p * (1 - p))
            self.trees.append(tree)
            f += tree[2][leaf]
        return self

    def _tree(self, b: np.ndarray, flat: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Split features and bins by node in heap order, values of leaves, and each row's leaf."""
        n_f, inner = b.shape[1], (1 << self.depth) - 1
        feature, cut = np.full(inner, -1), np.zeros(inner, np.int64)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, nodes = (1 << level) - 1, 1 << level
            size = n_f * self.bins
            key = ((node - first)[:, None] * size + flat).ravel()
            sums = [np.bincount(key, np.repeat(w, n_f), nodes * size).reshape(nodes, n_f, self.bins) for w in (g, h, np.ones(len(g)))]
            gl, hl, nl = (np.cumsum(s, axis=2) for s in sums)
            gt, ht, nt = (s[:, :, -1:] for s in (gl, hl, nl))
            gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
            gain = np.where((nl >= self.least) & (nt - nl >= self.least), gain, 0).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            for k in range(nodes):
                if gain[k, best[k]] > 1e-6:
                    feature[first + k], cut[first + k] = divmod(int(best[k]), self.bins)
            at = feature[node]
            right = (at >= 0) & (b[np.arange(len(g)), np.maximum(at, 0)] > cut[node])
            node = 2 * node + 1 + right
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return (feature, cut, -self.rate * gs / (hs + self.ridge)), leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        f = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = feature[node]
                node = 2 * node + 1 + ((at >= 0) & (b[rows, np.maximum(at, 0)] > cut[node]))
            f += value[node - len(feature)]
        return 1 / (1 + np.exp(-f))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Isotonic regression of the label on the raw score over rows not used by ``fit`` (pool adjacent violators)."""
        if not len(y):
            return self
        s = self.raw(x)
        order = np.argsort(s, kind="stable")
        at, inverse = np.unique(s[order], return_inverse=True)
        total, n = np.bincount(inverse, y[order]), np.bincount(inverse).astype(float)
        blocks: list[list[float]] = []
        for i in range(len(at)):
            blocks.append([total[i], n[i], at[i], at[i]])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                t, m, _, hi = blocks.pop()
                blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + m, blocks[-1][2], hi]
        xs, ys = [], []
        for t, m, lo, hi in blocks:
            xs += [lo] if lo == hi else [lo, hi]
            ys += [t / m] * (1 if lo == hi else 2)
        self.steps = (np.array(xs), np.array(ys))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0.0, 1.0)
