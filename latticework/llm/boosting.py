"""Gradient-boosted trees for two classes, in numpy: logistic loss, Newton leaves, quantile thresholds, isotonic calibration."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.2, least: float = 4.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.least, self.ridge = trees, depth, rate, least, ridge
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0
        self.group: int | None = None
        self.steps: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """x: rows, features; y: 0 or 1. Every tree is a full one: inner nodes in level order, then leaves."""
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower")) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)  # value <= cuts[k] iff code <= k
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.start)
        inner = (1 << self.depth) - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
            at = np.zeros(len(y), np.int64)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                best = 1e-6
                if len(rows):
                    whole_g, whole_h = g[rows].sum(), h[rows].sum()
                    for f, own in enumerate(cuts):
                        if not len(own):
                            continue
                        lg = np.cumsum(np.bincount(codes[rows, f], g[rows], len(own) + 1))[:-1]
                        lh = np.cumsum(np.bincount(codes[rows, f], h[rows], len(own) + 1))[:-1]
                        n = np.cumsum(np.bincount(codes[rows, f], minlength=len(own) + 1))[:-1]
                        gain = lg**2 / (lh + self.ridge) + (whole_g - lg) ** 2 / (whole_h - lh + self.ridge) - whole_g**2 / (whole_h + self.ridge)
                        gain[(n < self.least) | (len(rows) - n < self.least)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, feature[node], cut[node] = gain[k], f, own[k]
                at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            for i in range(inner + 1):
                rows = at == inner + i
                leaf[i] = self.rate * g[rows].sum() / (h[rows].sum() + self.ridge)
            self.grown.append((feature, cut, leaf))
            z += leaf[at - inner]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.grown:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            z += leaf[at - len(feature)]
        return z

    def calibrate(self, x: np.ndarray, y: np.ndarray, group: int | None = None) -> Boosted:
        """Isotonic regression of y on the margin; of rows that share a value of feature group on their own, if given."""
        self.group = group
        names = np.zeros(len(x)) if group is None else x[:, group]
        self.steps = {name: self._isotonic(self.margin(x[names == name]), y[names == name]) for name in np.unique(names).tolist()}
        return self

    @staticmethod
    def _isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends and values of the blocks, by pooling neighbours that fall."""
        order = np.argsort(z, kind="stable")
        blocks: list[list[float]] = []
        for m, v in zip(z[order], y[order], strict=True):
            blocks.append([v, 1.0, m])
            while len(blocks) > 1 and (blocks[-2][2] == blocks[-1][2] or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
                s, n, last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, last]
        return np.array([b[2] for b in blocks]), np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; 0 in a group that calibration has not seen."""
        z, out = self.margin(x), np.zeros(len(x))
        names = np.zeros(len(x)) if self.group is None else x[:, self.group]
        for name, (ends, values) in self.steps.items():
            own = names == name
            out[own] = values[np.minimum(np.searchsorted(ends, z[own], "left"), len(values) - 1)]
        return out
