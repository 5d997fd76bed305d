"""Gradient-boosted trees for two classes with monotonic constraints, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees as flat node arrays; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray  # a value of at most the threshold goes left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Sum of all trees' leaves for each row: every tree and row steps down at once."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            low = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(low, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 32,
    l2: float = 1.0,
    least: int = 10,
) -> Trees:
    """Fit to 0/1 labels. monotone[j] is 1 (rising), -1 (falling) or 0 for feature j.

    Splits are at quantiles. A split on a constrained feature must order its two
    children; the middle of their values then bounds all nodes below either.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def leaf(value: float) -> int:
        nodes.append([0, 0.0, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def best_split(rows, g, h, low, high):
        gain_of = lambda v, gs, hs: -(gs * v + 0.5 * (hs + l2) * v * v)
        weight = lambda gs, hs: np.clip(-gs / (hs + l2), low, high)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (gain_of(weight(gs, hs), gs, hs) + 1e-6, None)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            size = len(e) + 1
            b = binned[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            vl, vr = weight(gl, hl), weight(gs - gl, hs - hl)
            gain = gain_of(vl, gl, hl) + gain_of(vr, gs - gl, hs - hl)
            fine = (nl >= least) & (len(rows) - nl >= least) & (monotone[j] * (vr - vl) >= 0)
            gain = np.where(fine, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, k, float(vl[k]), float(vr[k])))
        return best[1]

    def grow(rows, g, h, level, low, high) -> int:
        split = best_split(rows, g, h, low, high) if level < depth and len(rows) >= 2 * least else None
        if split is None:
            value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
            score[rows] += rate * value
            return leaf(rate * value)
        j, k, vl, vr = split
        goes = binned[rows, j] <= k
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(
            int(monotone[j]), ((low, high), (low, high))
        )
        at = leaf(0.0)
        left = grow(rows[goes], g, h, level + 1, *bounds[0])
        right = grow(rows[~goes], g, h, level + 1, *bounds[1])
        nodes[at] = [j, float(edges[j][k]), left, right, 0.0]
        return at

    everything = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(everything, p - y, p * (1 - p), 0, -np.inf, np.inf))
    table = np.array(nodes)
    return Trees(
        np.array(roots), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int),
        table[:, 3].astype(int), table[:, 4], depth, base,
    )
