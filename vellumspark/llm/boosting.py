"""Gradient-boosted trees of depth three on small dense tables, with logistic loss; trained in numpy on the driver."""

from __future__ import annotations

import math

import numpy as np


class Boosted:
    """Trees are lists of (feature, threshold, left, right) or a leaf value; small enough to be sent with a task."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 32, least: int = 20) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.base, self.trees = math.log(share / (1 - share)), []
        if len(y) == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            tree = self._grow(binned, edges, grad, hess, np.arange(len(y)), self.depth, score)
            self.trees.append(tree)
        return self

    def _grow(self, b: np.ndarray, edges: list, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int, score: np.ndarray):
        sg, sh = g[at].sum(), h[at].sum()
        best = (1e-6, -1, -1)
        if depth and len(at) >= 2 * self.least:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                n = len(e) + 1
                gg = np.cumsum(np.bincount(b[at, j], g[at], n))[:-1]
                hh = np.cumsum(np.bincount(b[at, j], h[at], n))[:-1]
                cc = np.cumsum(np.bincount(b[at, j], minlength=n))[:-1]
                gain = gg**2 / (hh + 1) + (sg - gg) ** 2 / (sh - hh + 1) - sg**2 / (sh + 1)
                gain[(cc < self.least) | (len(at) - cc < self.least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] < 0:
            value = float(self.rate * sg / (sh + 1))
            score[at] += value
            return value
        _, j, k = best
        left = b[at, j] <= k
        return (j, float(edges[j][k]), self._grow(b, edges, g, h, at[left], depth - 1, score), self._grow(b, edges, g, h, at[~left], depth - 1, score))

    def chance(self, row: list[float]) -> float:
        s = self.base
        for t in self.trees:
            while type(t) is tuple:
                t = t[2] if row[t[0]] <= t[1] else t[3]
            s += t
        return 1 / (1 + math.exp(-s)) if s > -500 else 0.0
