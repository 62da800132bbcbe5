"""Gradient boosted trees for two classes, on a few thousand rows in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


@dataclass
class Node:
    value: float
    feature: int = -1
    bound: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(x), self.value)
        out, high = np.empty(len(x)), x[:, self.feature] >= self.bound
        out[~high] = self.low.predict(x[~high])
        out[high] = self.high.predict(x[high])
        return out


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int, l2: float) -> Node:
    node = Node(float(grad.sum() / (hess.sum() + l2)))
    if depth == 0 or len(x) < 2 * least:
        return node
    whole, best = grad.sum() ** 2 / (hess.sum() + l2), (1e-6, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, g, h = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if len(cut):
            gain = g[cut] ** 2 / (h[cut] + l2) + (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + l2) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(v[cut[k]] + v[cut[k] + 1]) / 2)
    if best[1] >= 0:
        node.feature, node.bound = best[1], best[2]
        high = x[:, node.feature] >= node.bound
        node.low = _grow(x[~high], grad[~high], hess[~high], depth - 1, least, l2)
        node.high = _grow(x[high], grad[high], hess[high], depth - 1, least, l2)
    return node


@dataclass
class BoostedTrees:
    """Additive trees under logistic loss; the same rows always give the same trees."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    least: int = 10
    l2: float = 1.0
    start: float = 0.0
    trees: list[Node] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start, self.trees = float(np.log(share / (1 - share))), []
        score = np.full(len(x), self.start)
        for _ in range(self.rounds):
            p = _sigmoid(score)
            tree = _grow(x, y - p, p * (1 - p), self.depth, self.least, self.l2)
            score += self.rate * tree.predict(x)
            self.trees.append(tree)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += self.rate * tree.predict(x)
        return _sigmoid(score)


def threshold_for(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score at which what scores as much or more is right with the given precision; above all if none."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(scores[order][1:] < scores[order][:-1], True)
    ok = np.flatnonzero((right >= precision) & last)
    return float(scores[order][ok[-1]]) if len(ok) else 2.0
