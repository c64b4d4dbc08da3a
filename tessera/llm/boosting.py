"""Gradient-boosted trees for two classes over small integer bins, in numpy: trained on the driver, applied anywhere."""

from __future__ import annotations


class Boosted:
    """Additive trees of fixed depth; a node sends a row right if its feature's value is above the threshold."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 20):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list = []
        self.base = 0.0

    def fit(self, x, y):
        """x: floats (rows, features); y: 0 or 1."""
        import numpy as np

        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        rate = y.mean().clip(1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            at = np.zeros(len(y), dtype=int)
            for node in range(size):
                own = np.flatnonzero(at == node)
                if not len(own):
                    continue
                g, h = gradient[own].sum(), weight[own].sum()
                value[node] = self.rate * g / (h + 1.0)
                if node >= 2**self.depth - 1 or len(own) < 2 * self.least:
                    continue
                best = (1e-6, -1, 0)
                for j, c in enumerate(cuts):
                    if len(c):
                        gl, hl, nl = (np.cumsum(np.bincount(binned[own, j], weights=w, minlength=len(c) + 1))[:-1] for w in (gradient[own], weight[own], None))
                        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                        gain[(nl < self.least) | (len(own) - nl < self.least)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                if best[1] >= 0:
                    feature[node], threshold[node] = best[1], cuts[best[1]][best[2]]
                    right = binned[own, best[1]] > best[2]
                    at[own] = 2 * node + 1 + right
            leaf = at
            score = score + value[leaf]
            self.trees.append((feature, threshold, value))
        return self

    def state(self) -> tuple:
        """Plain values, which any process can load."""
        return self.depth, self.base, self.trees

    @classmethod
    def of(cls, state: tuple) -> Boosted:
        made = cls()
        made.depth, made.base, made.trees = state
        return made

    def logit(self, x):
        import numpy as np

        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (x[rows, f] > threshold[at]), at)
            out += value[at]
        return out
