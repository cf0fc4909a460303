"""Gradient-boosted trees for a yes/no label: small, monotone where asked, scored as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All nodes of all trees: a leaf points to itself. ``base`` and leaf values add up to log-odds."""

    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray  # node for values <= threshold
    high: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of statistics: every row walks all trees at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.low[at], self.high[at])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[at].sum(axis=1), -50, 50)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: list[int],
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    ridge: float = 5.0,
    weight: np.ndarray | None = None,
) -> Trees:
    """Logistic boosting on binned statistics.

    ``monotone`` holds -1, 0 or 1 for each column. A split in a constrained column must order its two sides'
    values the right way, and everything below it stays on its side of the two values' mean; so the sum of all
    trees is monotone. ``weight`` (1 unless given) counts a row that often. One class only, or no rows, gives no trees and the smoothed share.
    """
    n, width = x.shape
    w = np.ones(n) if weight is None else weight
    share = ((w * y).sum() + 0.5) / (w.sum() + 1)
    nodes: list[list] = []  # feature, threshold, low, high, value
    roots: list[int] = []
    base = float(np.log(share / (1 - share)))
    if 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        odds = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-odds))
            grower = _Grower(binned, cuts, w * (p - y), w * p * (1 - p), monotone, bins, ridge, rate, nodes)
            roots.append(grower.grow(np.arange(n), depth, -np.inf, np.inf))
            odds += grower.step
    if not roots:
        nodes, roots, depth = [[0, 0.0, 0, 0, 0.0]], [0], 0
    f, t, low, high, v = map(np.array, zip(*nodes))
    return Trees(f, t, low, high, v, np.array(roots), depth, base)


class _Grower:
    """One tree, appended to ``nodes``; ``step`` gets every training row's leaf value."""

    def __init__(self, binned, cuts, gradient, weight, monotone, bins, ridge, rate, nodes) -> None:
        self.binned, self.cuts, self.gradient, self.weight = binned, cuts, gradient, weight
        self.monotone, self.bins, self.ridge, self.rate, self.nodes = monotone, bins, ridge, rate, nodes
        self.step = np.zeros(len(gradient))

    def grow(self, rows: np.ndarray, depth: int, least: float, most: float) -> int:
        number = len(self.nodes)
        self.nodes.append([0, 0.0, number, number, 0.0])
        found = self._best(rows, least, most) if depth and len(rows) > 1 else None
        if found is None:
            g, h = self.gradient[rows].sum(), self.weight[rows].sum()
            value = self.rate * min(max(-g / (h + self.ridge), least), most)
            self.nodes[number][4] = value
            self.step[rows] = value
            return number
        j, cut, left, right = found
        goes = self.binned[rows, j] <= cut
        middle = (left + right) / 2
        bounds = {1: ((least, middle), (middle, most)), -1: ((middle, most), (least, middle))}
        below, above = bounds.get(self.monotone[j], ((least, most), (least, most)))
        low = self.grow(rows[goes], depth - 1, *below)
        high = self.grow(rows[~goes], depth - 1, *above)
        self.nodes[number][:4] = [j, float(self.cuts[j][cut]), low, high]
        return number

    def _best(self, rows: np.ndarray, least: float, most: float):
        """The split with the largest gain: column, bin, and the values of both sides."""
        gain, found = 1e-6, None
        g, h = self.gradient[rows], self.weight[rows]
        whole = self._worth(g.sum(), h.sum(), least, most)[1]
        for j in range(self.binned.shape[1]):
            cuts = len(self.cuts[j])
            if not cuts:
                continue
            b = self.binned[rows, j]
            gl = np.cumsum(np.bincount(b, g, self.bins + 1))[:cuts]
            hl = np.cumsum(np.bincount(b, h, self.bins + 1))[:cuts]
            nl = np.cumsum(np.bincount(b, minlength=self.bins + 1))[:cuts]
            left, worth_l = self._worth(gl, hl, least, most)
            right, worth_r = self._worth(g.sum() - gl, h.sum() - hl, least, most)
            allowed = (nl > 0) & (nl < len(rows)) & (self.monotone[j] * (right - left) >= 0)
            gains = np.where(allowed, worth_l + worth_r - whole, -np.inf)
            k = int(np.argmax(gains))
            if gains[k] > gain:
                gain, found = gains[k], (j, k, float(left[k]), float(right[k]))
        return found

    def _worth(self, g, h, least: float, most: float):
        """Best allowed value of a leaf and how much it lowers the loss."""
        value = np.clip(-g / (h + self.ridge), least, most)
        return value, -(2 * g * value + (h + self.ridge) * value * value) / 2
