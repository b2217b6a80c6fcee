"""Gradient-boosted regression trees on binned features, in NumPy; for bounded training sets on the driver and batches on the executors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 48


@dataclass(frozen=True)
class Boosted:
    edges: list[np.ndarray]
    base: float
    feature: np.ndarray  # trees x inner nodes, -1: no split
    cut: np.ndarray  # bin up to which a row goes left
    leaf: np.ndarray  # trees x leaves

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(self.feature) or not len(x):
            return out
        b, depth = self.bins(x), int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + ((f[node] >= 0) & (b[rows, np.maximum(f[node], 0)] > c[node]))
            out += leaf[node - (1 << depth) + 1]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 150, depth: int = 4, rate: float = 0.1, least: int = 4, ridge: float = 1.0) -> Boosted:
    """Squared loss. Each node takes the split of greatest gain among all features and bins; the first of equals."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="nearest")) if n else np.zeros(0) for j in range(m)]
    model = Boosted(edges, float(y.mean()) if n else 0.0, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)))
    if n < 2 * least:
        return model
    b = model.bins(x).astype(np.int64)
    offset = b + np.arange(m) * BINS
    rest = y - model.base
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        f, c = np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64)
        node = np.zeros(n, np.int64)
        counts = values = np.zeros((0, m, BINS))
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            # only the rows of left children are counted, the right ones are what is left of their parents
            rows, of, half = (np.arange(n), node, 1) if not level else (np.flatnonzero(node & 1), (node - first) // 2, width // 2)
            at = (of[rows][:, None] * (m * BINS) + offset[rows]).ravel()
            left = np.bincount(at, minlength=half * m * BINS).reshape(half, m, BINS)
            left_sum = np.bincount(at, weights=np.repeat(rest[rows], m), minlength=half * m * BINS).reshape(half, m, BINS)
            if level:
                left, left_sum = (np.stack([x, y - x], 1).reshape(width, m, BINS) for x, y in ((left, counts), (left_sum, values)))
            counts, values = left, left_sum
            total, sums = counts.cumsum(2), values.cumsum(2)
            nt, st = total[:, :, -1:], sums[:, :, -1:]
            gain = sums**2 / (total + ridge) + (st - sums) ** 2 / (nt - total + ridge) - st**2 / (nt + ridge)
            gain[(total < least) | (nt - total < least)] = -1
            flat = gain.reshape(width, -1)
            best = flat.argmax(1)
            good = flat[np.arange(width), best] > 1e-9
            f[first : first + width][good] = best[good] // BINS
            c[first : first + width][good] = best[good] % BINS
            node = 2 * node + 1 + ((f[node] >= 0) & (b[np.arange(n), np.maximum(f[node], 0)] > c[node]))
        where = node - (1 << depth) + 1
        value = rate * np.bincount(where, rest, 1 << depth) / (np.bincount(where, minlength=1 << depth) + ridge)
        rest = rest - value[where]
        features.append(f)
        cuts.append(c)
        leaves.append(value)
    return Boosted(edges, model.base, np.array(features), np.array(cuts), np.array(leaves))
