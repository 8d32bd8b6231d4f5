"""Gradient-boosted trees for two classes, trained on a bounded sample with numpy and applied to batches of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Trees of one depth over binned features; logistic loss; ``edges`` holds the bin borders of each feature."""

    edges: list[np.ndarray]
    feature: np.ndarray  # (trees, nodes) feature split on, -1 at leaves
    border: np.ndarray  # (trees, nodes) rows with a bin above it go right
    value: np.ndarray  # (trees, nodes) score of a leaf
    start: float
    depth: int

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1).astype(np.int16)

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0) -> "BoostedTrees":
        """Fits ``trees`` trees to rows ``x`` with classes ``y`` (0 or 1); needs no randomness, so it is repeatable."""
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)] if n else [np.zeros(0)] * f
        for j in range(f):  # rare flags must not vanish between quantiles
            values = np.unique(x[:, j])
            if len(values) <= bins:
                edges[j] = (values[1:] + values[:-1]) / 2
        binned = cls._bins(x, edges)
        width = max([2, *(len(e) + 1 for e in edges)])
        nodes = 2 ** (depth + 1) - 1
        p = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
        self = cls(edges, np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes), np.int32), np.zeros((trees, nodes)), float(np.log(p / (1 - p))), depth)
        score = np.full(n, self.start)
        for t in range(trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                local = at - first
                live = (local >= 0) & (local < count)
                best_gain, best_f, best_b = np.full(count, 1e-6), np.full(count, -1), np.zeros(count, np.int64)
                for j in range(f):
                    key = local[live] * width + binned[live, j]
                    hg = np.bincount(key, g[live], count * width).reshape(count, width)
                    hh = np.bincount(key, h[live], count * width).reshape(count, width)
                    cg, ch = hg.cumsum(1), hh.cumsum(1)
                    tg, th = cg[:, -1:], ch[:, -1:]
                    ok = (ch >= least * 0.05) & (th - ch >= least * 0.05)
                    gain = np.where(ok, cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1), 0)
                    b = gain.argmax(1)
                    top = gain[np.arange(count), b]
                    better = top > best_gain
                    best_gain, best_f, best_b = np.where(better, top, best_gain), np.where(better, j, best_f), np.where(better, b, best_b)
                self.feature[t, first : first + count] = best_f
                self.border[t, first : first + count] = best_b
                split = live & (best_f[np.clip(local, 0, count - 1)] >= 0)
                rows = np.flatnonzero(split)
                right = binned[rows, best_f[local[rows]]] > best_b[local[rows]]
                at[rows] = 2 * at[rows] + 1 + right
            sums_g, sums_h = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
            self.value[t] = rate * sums_g / (sums_h + 1)
            score += self.value[t, at]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned = self._bins(x, self.edges)
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, border, value in zip(self.feature, self.border, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                down = f >= 0
                right = binned[rows, np.maximum(f, 0)] > border[at]
                at = np.where(down, 2 * at + 1 + right, at)
            score += value[at]
        return 1 / (1 + np.exp(-score))
