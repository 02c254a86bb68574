"""Gradient-boosted trees with monotonic constraints, kept as flat numpy node arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """All trees in one set of node arrays; a leaf has feature -1 and is its own child. ``roots`` are where trees begin."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for the rows of ``x``: all rows walk a tree together, one level at a time."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                below = x[rows, np.maximum(self.feature[at], 0)] <= self.cut[at]
                at = np.where(below, self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


class _Grown:
    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []

    def leaf(self, value: float) -> int:
        at = len(self.feature)
        for column, x in ((self.feature, -1), (self.cut, 0.0), (self.left, at), (self.right, at), (self.value, value)):
            column.append(x)
        return at


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic boosting on binned features.

    ``monotone`` gives +1 or -1 for features in which the score may only rise or fall: a split that would turn the
    other way is not taken, and values below a split stay on their side of the middle of its two leaves. Without rows,
    or with one class only, the score is constant.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) if len(x) else np.empty(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1) if len(x) else np.empty(x.shape, int)
    out, roots, score = _Grown(), [], np.full(len(x), base)
    for _ in range(trees if len(np.unique(y)) == 2 else 0):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, p * (1 - p)
        change = np.zeros(len(x))

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = gradient[rows].sum(), weight[rows].sum()
            value = float(np.clip(g / (h + ridge), low, high))
            best = (1e-6, None)
            for f in range(x.shape[1] if level else 0):
                size = len(cuts[f]) + 1
                gl = np.cumsum(np.bincount(binned[rows, f], gradient[rows], size))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], weight[rows], size))[:-1]
                if not len(gl):
                    continue
                vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((g - gl) / (h - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                bad = (hl < least) | (h - hl < least) | (monotone.get(f, 0) * (vr - vl) < 0)
                gain[bad] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, float(vl[k]), float(vr[k])))
            at = out.leaf(rate * value)
            if best[1] is None:
                change[rows] = rate * value
                return at
            f, k, vl, vr = best[1]
            below = binned[rows, f] <= k
            middle, way = (vl + vr) / 2, monotone.get(f, 0)
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[way]
            out.feature[at], out.cut[at] = f, float(cuts[f][k])
            out.left[at] = grow(rows[below], level - 1, *bounds[0])
            out.right[at] = grow(rows[~below], level - 1, *bounds[1])
            return at

        roots.append(grow(np.arange(len(x)), depth, -np.inf, np.inf))
        score = score + change
    kinds = ((out.feature, np.int64), (out.cut, float), (out.left, np.int64), (out.right, np.int64), (out.value, float), (roots, np.int64))
    return Trees(*[np.array(column, kind) for column, kind in kinds], depth, base)
