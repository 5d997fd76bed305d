"""Linear-chain conditional random field over the lines of documents, in numpy.

Two states per line, bad (0) and good (1). A line's evidence are its own features and
those of the lines before and after it; neighbouring states are tied by a 2 x 2 table
that rewards equal states, alike for both, so that a lone line has no leaning of its own.
All chains of a batch step together: in step k every chain with more than k lines moves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Parameters; features are (x - mean) / scale."""

    weights: np.ndarray  # evidence for good
    bias: float
    ties: np.ndarray  # ties[a, b]: state a before state b
    mean: np.ndarray
    scale: np.ndarray


class Layout:
    """Where the lines of chains lie: chain i holds lines first[i] up to first[i + 1]."""

    def __init__(self, lengths: np.ndarray):
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        self.lengths = lengths
        order = np.argsort(-lengths, kind="stable")
        self.start = self.first[:-1][order]
        self.long = -np.sort(-lengths)

    def steps(self):
        """For each step the lines of all chains that reach it, longest chains first."""
        most = int(self.long[0]) if len(self.long) else 0
        active = np.searchsorted(-self.long, -np.arange(most), side="left")
        for k in range(most):
            yield self.start[: active[k]] + k


def with_neighbours(x: np.ndarray, layout: Layout) -> np.ndarray:
    """Features of each line, the line before and the line after; zeros beyond the ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    filled = layout.lengths > 0
    before[layout.first[:-1][filled]] = 0
    after[layout.first[1:][filled] - 1] = 0
    return np.concatenate([x, before, after], axis=1)


def marginals(score: np.ndarray, ties: np.ndarray, layout: Layout, weight: np.ndarray | None = None):
    """P(good) per line; with a `weight` per line, also the weighted sum of P of each pair of states.

    `score` is the evidence for good over bad of each line. Messages are normed at every step.
    """
    e = np.stack([np.zeros(len(score)), np.clip(score, -30, 30)], axis=1)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    m = np.exp(ties)
    steps = list(layout.steps())
    forward, backward = np.empty_like(e), np.ones_like(e)
    for k, at in enumerate(steps):
        a = e[at] if k == 0 else (forward[at - 1] @ m) * e[at]
        forward[at] = a / a.sum(axis=1, keepdims=True)
    for at in reversed(steps[1:]):
        b = (backward[at] * e[at]) @ m.T
        backward[at - 1] = b / b.sum(axis=1, keepdims=True)
    p = forward * backward
    p /= p.sum(axis=1, keepdims=True)
    if weight is None:
        return p[:, 1]
    total = np.zeros((2, 2))
    if len(steps) > 1:
        at = np.concatenate(steps[1:])
        joint = forward[at - 1][:, :, None] * m * (e[at] * backward[at])[:, None, :]
        total = (weight[at][:, None, None] * joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p[:, 1], total


def line_scores(chain: Chain, x: np.ndarray, layout: Layout) -> np.ndarray:
    """P(good) of each line, given all lines of its document."""
    x = with_neighbours((x - chain.mean) / chain.scale, layout)
    return marginals(x @ chain.weights + chain.bias, chain.ties, layout)


def fit(x: np.ndarray, lengths: np.ndarray, good: np.ndarray, rounds: int = 150, rate: float = 0.1, l2: float = 1e-3) -> Chain:
    """Maximise the likelihood of line labels (a document's label on each of its lines).

    Adam on the exact gradient: labels' minus expected features. Documents count alike,
    and so do the two classes in sum.
    """
    layout = Layout(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    x = with_neighbours((x - mean) / scale, layout)
    share = np.where(good == 1, 1 / max(good.sum(), 1), 1 / max((1 - good).sum(), 1)) / 2
    weight = (share / np.maximum(lengths, 1))[doc]
    y = good[doc].astype(float)
    theta = np.zeros(x.shape[1] + 2)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        w, bias, ties = theta[:-2], theta[-2], theta[-1] * np.eye(2)
        p, pairs = marginals(x @ w + bias, ties, layout, weight)
        gap = weight * (y - p)
        # Lines of a document have equal labels, so every pair should be equal.
        slope = np.concatenate([x.T @ gap - l2 * w, [gap.sum(), pairs[0, 1] + pairs[1, 0] - l2 * theta[-1]]])
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta + rate * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.999**r)) + 1e-8)
    return Chain(theta[:-2], float(theta[-2]), theta[-1] * np.eye(2), mean, scale)
