"""A small gradient-boosted tree model: fitted with numpy, applied as a Column expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


@dataclass
class BoostedTrees:
    """Logistic boosting with second-order leaf values and exact splits."""

    rounds: int = 24
    depth: int = 3
    rate: float = 0.3
    penalty: float = 1.0
    least: int = 8
    base: float = 0.0
    trees: list[Node] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._values(tree, x)
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> Node:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        node = Node(value=float(-self.rate * total_g / (total_h + self.penalty)))
        if depth == 0 or len(rows) < 2 * self.least:
            return node
        best = (1e-6, -1, 0.0)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v = x[order, f]
            gl, hl = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
            gain = gl**2 / (hl + self.penalty) + (total_g - gl) ** 2 / (total_h - hl + self.penalty) - total_g**2 / (total_h + self.penalty)
            n = np.arange(1, len(order))
            gain[(v[1:] == v[:-1]) | (n < self.least) | (n > len(order) - self.least)] = -np.inf
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], f, float(v[i] + v[i + 1]) / 2)
        if best[1] < 0:
            return node
        node.feature, node.threshold = best[1], best[2]
        goes_low = x[rows, node.feature] <= node.threshold
        node.low, node.high = self._grow(x, g, h, rows[goes_low], depth - 1), self._grow(x, g, h, rows[~goes_low], depth - 1)
        return node

    def _values(self, node: Node, x: np.ndarray) -> np.ndarray:
        if node.feature < 0:
            return np.full(len(x), node.value)
        return np.where(x[:, node.feature] <= node.threshold, self._values(node.low, x), self._values(node.high, x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._values(t, x) for t in self.trees)

    def column(self, feature: Callable[[int], Column]) -> Column:
        """The log-odds as nested conditionals over feature columns."""

        def walk(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(node.value)
            return F.when(feature(node.feature) <= node.threshold, walk(node.low)).otherwise(walk(node.high))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + walk(tree)
        return total


def threshold_for_precision(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut at which held-out precision reaches ``precision``; infinite if none does."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(scores[order][1:] != scores[order][:-1], True)  # equal scores go together
    good = np.flatnonzero((hits >= precision) & last)
    if not len(good):
        return float("inf")
    cut = scores[order][good[-1]]
    lower = scores[scores < cut]
    return float((cut + lower.max()) / 2) if len(lower) else float(cut) - 1.0
