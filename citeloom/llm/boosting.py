"""Gradient-boosted trees with logistic loss, grown from histograms.

A level of a tree needs only the sums of slopes and bends by node, feature and bin, so
rows may lie in memory (``boosted``) or in a table of any size (``grown``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of equal depth as arrays: node k has the children 2k + 1 and 2k + 2."""

    start: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


#: Bits after the point of slopes and bends: sums of whole numbers have no order.
BITS = 24


def sums(model: Boosted, feature: np.ndarray, cut: np.ndarray, level: int, coded: np.ndarray, y: np.ndarray,
         n: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and bends, as whole numbers, by node of the level, feature and bin; row i
    of ``coded`` counts ``n[i]`` times, and ``model`` and ``cut`` are of coded values."""
    p = model.probability(coded)
    rows, node = np.arange(len(y)), np.zeros(len(y), np.int64)
    for _ in range(level):
        node = 2 * node + 1 + (coded[rows, feature[node]] > cut[node])
    at, many = node - (2**level - 1), coded.shape[1]
    out = []
    for value in (y - p, p * (1 - p)):
        units = np.rint(value * (1 << BITS)) * n
        by = [np.bincount(at * wide + coded[:, j], units, 2**level * wide) for j in range(many)]
        out.append(np.stack(by).reshape(many, -1, wide).transpose(1, 0, 2).astype(np.int64))
    return out[0], out[1]


def grown(histogram: Callable, share: float, bins: list[int], rounds: int = 50, depth: int = 3, rate: float = 0.2,
          ridge: float = 1.0) -> Boosted:
    """Trees of coded features; ``histogram(model, feature, cut, level)`` gives the sums
    of all rows, ``share`` is that of label 1, and feature j has ``bins[j]`` bins."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), depth)
    for _ in range(rounds):
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            s, b = (v / (1 << BITS) for v in histogram(model, feature, cut, level))
            total_s, total_b = s[:, 0].sum(1), b[:, 0].sum(1)
            whole, best = total_s**2 / (total_b + ridge), np.zeros(n)
            # Sums left of the chosen cut; without one all rows go left.
            left_s, left_b = total_s.copy(), total_b.copy()
            for j, wide in enumerate(bins):
                if wide < 2:
                    continue
                ls, lb = s[:, j].cumsum(1)[:, : wide - 1], b[:, j].cumsum(1)[:, : wide - 1]
                gain = ls**2 / (lb + ridge) + (total_s[:, None] - ls) ** 2 / (total_b[:, None] - lb + ridge) - whole[:, None]
                k = gain.argmax(1)
                value = gain[np.arange(n), k]
                better = np.flatnonzero(value > best + 1e-9)
                best[better] = value[better]
                feature[first + better], cut[first + better] = j, k[better]
                left_s[better], left_b[better] = ls[better, k[better]], lb[better, k[better]]
        sides = [np.stack(v, 1).ravel() for v in ((left_s, total_s - left_s), (left_b, total_b - left_b))]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(rate * sides[0] / (sides[1] + ridge))
    return model


def decoded(model: Boosted, cuts: list[np.ndarray]) -> Boosted:
    """The trees on features, where a value's code is the number of cuts below it."""
    real = [
        np.array([cuts[j][int(k)] if np.isfinite(k) else np.inf for j, k in zip(f, c, strict=True)])
        for f, c in zip(model.feature, model.cut, strict=True)
    ]
    return Boosted(model.start, model.depth, model.feature, real, model.leaf)


def coded(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many cuts lie below each value."""
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 32,
            ridge: float = 1.0) -> Boosted:
    """Fit on rows x with labels y (0 or 1)."""
    if len(y) < 2 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Boosted(float(np.log(share / (1 - share))), depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes, one, wide = coded(x, cuts), np.ones(len(y)), max(map(len, cuts)) + 1
    model = grown(
        lambda *at: sums(*at, codes, y, one, wide), float(y.mean()), [len(c) + 1 for c in cuts], rounds, depth, rate, ridge
    )
    return decoded(model, cuts)
