"""Gradient-boosted trees for two classes: histogram splits, full binary trees, log loss."""

from __future__ import annotations

import numpy as np


class Trees:
    """depth levels of splits each; node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, depth: int = 4, rounds: int = 40, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, part: float = 0.35):
        self.depth, self.rounds, self.rate, self.bins, self.ridge, self.part = depth, rounds, rate, bins, ridge, part
        self.feature: list[np.ndarray] = []
        self.limit: list[np.ndarray] = []
        self.value: list[np.ndarray] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        n, p = x.shape
        flag = ((x == 0) | (x == 1)).all(axis=0)
        edges = [np.zeros(1) if flag[j] else np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(p)]
        code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(p)], axis=1).astype(np.int64)
        mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if n else 0.5
        self.start = float(np.log(mean / (1 - mean)))
        full, everything, target = np.full(n, self.start), x, y
        inner = 2**self.depth - 1
        # features of two values: their sums are one matrix product
        two = np.flatnonzero([len(e) == 1 for e in edges])
        more = [j for j in range(p) if len(edges[j]) > 1]
        rng, all_codes, ones = np.random.default_rng(3), code, code[:, two].astype(float)
        for _ in range(self.rounds):
            # each tree sees a seeded part of the rows
            own = np.flatnonzero(rng.random(len(everything)) < self.part)
            x, y, code, n = everything[own], target[own], all_codes[own], len(own)
            own_ones = ones[own].T
            prob = 1 / (1 + np.exp(-full[own]))
            grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-9)
            feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                local = node - first
                gain, take = np.zeros(width), np.full((width, 2), -1)
                if len(two):
                    sums = np.zeros((n, 2 * width))
                    sums[np.arange(n), local], sums[np.arange(n), width + local] = grad, hess
                    gt, ht = (x[:, None] for x in np.split(sums.sum(0), 2))
                    right = (own_ones @ sums).T
                    gl, hl = gt - right[:width], ht - right[width:]
                    won = self._won(gl, hl, gt, ht)
                    b = won.argmax(1)
                    gain = won[np.arange(width), b]
                    take[gain > 1e-9] = np.stack([two[b], np.zeros(width, np.int64)], 1)[gain > 1e-9]
                for j in more:
                    m = len(edges[j]) + 1
                    key = local * m + code[:, j]
                    g = np.bincount(key, grad, width * m).reshape(width, m).cumsum(1)
                    h = np.bincount(key, hess, width * m).reshape(width, m).cumsum(1)
                    gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    won = self._won(gl, hl, gt, ht)
                    b = won.argmax(1)
                    top = won[np.arange(width), b]
                    better = top > gain + 1e-9
                    gain[better] = top[better]
                    take[better] = np.stack([np.full(width, j), b], 1)[better]
                for i in range(width):
                    if take[i, 0] >= 0:
                        feature[first + i], limit[first + i] = take[i, 0], edges[take[i, 0]][take[i, 1]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
            leaf = node - inner
            g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
            value = -self.rate * g / (h + self.ridge)
            self.feature.append(feature)
            self.limit.append(limit)
            self.value.append(value)
            full += self._leaf(everything, feature, limit, value)
        return self

    def _won(self, gl: np.ndarray, hl: np.ndarray, gt: np.ndarray, ht: np.ndarray) -> np.ndarray:
        """What splits win, by the sums to the left and all sums."""
        won = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
        won[(hl < 0.5) | (ht - hl < 0.5)] = 0
        return won

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return sum((self._leaf(x, *tree) for tree in zip(self.feature, self.limit, self.value)), np.full(len(x), self.start))

    def _leaf(self, x: np.ndarray, feature: np.ndarray, limit: np.ndarray, value: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
        return value[node - len(feature)]
