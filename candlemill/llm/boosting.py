"""Gradient-boosted trees over a few columns, kept as flat numpy node arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in one set of arrays; a leaf points to itself, so every row takes the same number of steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, monotone: Sequence[int], trees: int = 60, depth: int = 4, rate: float = 0.2,
        bins: int = 64, least: int = 8, ridge: float = 1.0) -> Forest:
    """Logistic loss, second-order gains, splits at up to ``bins`` quantiles per column.

    ``monotone`` has +1, -1 or 0 for each column: a score never falls (rises) as that column rises. A split that
    would go against it is not taken, and the values below a split on such a column are kept on either side of the
    middle between its two children, so that no later split can undo it.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(c) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1) if len(x) else np.zeros(x.shape, int)
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots, margin = [], np.full(len(y), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        nodes.append([0, np.inf, at, at, rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))])
        if level == depth or len(rows) < 2 * least:
            return at
        best = (1e-6, None)
        whole_g, whole_h = g[rows].sum(), h[rows].sum()
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            b, size = binned[rows, f], len(cut) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, w, minlength=size))[:-1] for w in (g[rows], h[rows], None))
            gr, hr, nr = whole_g - gl, whole_h - hl, len(rows) - nl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            # the loss that the two values take away, against one value for both
            gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - (gr * vr + (hr + ridge) * vr**2 / 2)
            gain -= whole_g**2 / (whole_h + ridge) / 2
            gain[(nl < least) | (nr < least) | (monotone[f] * (vr - vl) < 0)] = -1
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), (f, i, vl[i], vr[i]))
        if best[1] is None:
            return at
        f, i, vl, vr = best[1]
        middle, way = (vl + vr) / 2, monotone[f]
        below = binned[rows, f] <= i
        left = grow(rows[below], g, h, level + 1, middle if way < 0 else low, middle if way > 0 else high)
        right = grow(rows[~below], g, h, level + 1, middle if way > 0 else low, middle if way < 0 else high)
        nodes[at][:4] = [f, float(cuts[f][i]), left, right]
        return at

    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        q = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), q - y, q * (1 - q), 0, -np.inf, np.inf))
        tree = Forest(np.array([first]), *map(np.array, zip(*nodes)), 0.0, depth)
        margin += tree.margin(x)
    columns = list(zip(*nodes)) or [()] * 5
    kinds = (np.int64, float, np.int64, np.int64, float)
    return Forest(np.array(roots, np.int64), *(np.array(c, k) for c, k in zip(columns, kinds)), base, depth)
