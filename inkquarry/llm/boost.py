"""Gradient-boosted trees with logistic loss, for small feature tables: numpy only, the same result on every run."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of a fixed depth over binned features, with scores calibrated by isotonic regression on held-out rows."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.25
    bins: int = 16
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    threshold: float = 0.5
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Boosted:
        """``held`` marks the rows kept for calibration."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        train = ~held if held.any() and (~held).any() else np.ones(len(y), bool)
        self.edges = [self._cuts(x[:, j]) for j in range(x.shape[1])]
        b, t = self._binned(x[train]), y[train]
        p = np.clip(t.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(t), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            tree = self._tree(b, t - prob, prob * (1 - prob))
            self.trees.append(tree)
            score += self._walk(tree, b)
        self._calibrate(self.score(x[held]) if held.any() else self.score(x), y[held] if held.any() else y)
        return self

    def _cuts(self, v: np.ndarray) -> np.ndarray:
        """Between all distinct values if these are few, else at quantiles of the values and of the distinct values."""
        u = np.unique(v)
        if len(u) <= self.bins:
            return (u[1:] + u[:-1]) / 2
        at = np.linspace(0, 1, self.bins // 2 + 1)[1:-1]
        return np.unique(np.concatenate([np.quantile(v, at), np.quantile(u, at)]))

    def _tree(self, b: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner, n_bins = 2**self.depth - 1, self.bins + 1
        feature, cut, leaf = np.full(inner, -1), np.zeros(inner, int), np.zeros(2**self.depth)
        at = np.zeros(len(grad), int)
        for node in range(inner):
            rows = at == node
            g, h = grad[rows], hess[rows]
            best, total = 1e-6, (g.sum(), h.sum())
            for j in range(b.shape[1] if len(g) > 1 else 0):
                sg = np.cumsum(np.bincount(b[rows, j], g, n_bins))[:-1]
                sh = np.cumsum(np.bincount(b[rows, j], h, n_bins))[:-1]
                gain = sg**2 / (sh + 1) + (total[0] - sg) ** 2 / (total[1] - sh + 1) - total[0] ** 2 / (total[1] + 1)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, feature[node], cut[node] = gain[k], j, k
            right = rows & (b[:, feature[node]] > cut[node]) if feature[node] >= 0 else np.zeros_like(rows)
            at[rows], at[right] = 2 * node + 1, 2 * node + 2
        at -= inner
        for k in range(2**self.depth):
            rows = at == k
            leaf[k] = self.rate * grad[rows].sum() / (hess[rows].sum() + 1)
        return feature, cut, leaf

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        at = np.zeros(len(b), int)
        for _ in range(self.depth):
            f = feature[at]
            go = (f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > cut[at])
            at = 2 * at + 1 + go
        return leaf[at - (2**self.depth - 1)]

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        b = self._binned(x)
        return self.base + sum((self._walk(t, b) for t in self.trees), np.zeros(len(x)))

    def _calibrate(self, score: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []
        for s, t in zip(score[order], y[order], strict=True):
            blocks.append([t, 1, s])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                t2, n2, _ = blocks.pop()
                blocks[-1][0] += t2
                blocks[-1][1] += n2
        self.steps = np.array([x[2] for x in blocks]), np.array([x[0] / x[1] for x in blocks])
        self._choose(np.interp(score, *self.steps), y)

    def _choose(self, p: np.ndarray, y: np.ndarray) -> None:
        """The threshold with the best F1 on the held-out rows; of equal ones the nearest to a half."""
        levels = np.unique(p)
        cuts = np.concatenate([levels[:1], (levels[1:] + levels[:-1]) / 2])
        order = np.sort(p[y > 0.5])
        every = np.sort(p)
        hit = len(order) - np.searchsorted(order, cuts)
        said = len(every) - np.searchsorted(every, cuts)
        f1 = 2 * hit / np.maximum(said + len(order), 1)
        best = np.flatnonzero(f1 >= f1.max() - 1e-12)
        k = best[np.argmin(np.abs(cuts[best] - 0.5))]
        # anywhere between two levels is as good: as near to a half as that allows
        below, above = (levels[k - 1] if k else 0.0), levels[k]
        self.threshold = float(min(max(0.5, below + 1e-9), above))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; scores between two steps are interpolated."""
        s = self.score(x)
        return np.interp(s, *self.steps) if len(self.steps[0]) else 1 / (1 + np.exp(-s))
