"""Small dense linear models, fitted on a bounded sample on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    """Full-batch gradient steps with per-weight sizes."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150, rate: float = 0.1) -> np.ndarray:
    """Weights, the intercept last.  Without both classes only the intercept differs from 0."""
    w = np.zeros(x.shape[1] + 1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():
        return w
    adam = Adam(len(w), rate)
    for _ in range(steps):
        e = (sigmoid(x @ w[:-1] + w[-1]) - y) / len(y)
        adam.step(w, np.append(e @ x + l2 * w[:-1], e.sum()))
    return w


def fit_positive_unlabelled(positive: np.ndarray, unlabelled: np.ndarray, prior: float, size: int | None = None,
                            l2: float = 1e-6, steps: int = 3000, rate: float = 0.1) -> np.ndarray:
    """Weights that minimise the non-negative risk of positive-unlabelled
    learning with logistic loss; the intercept last.

    The rows are vectors or, with ``size`` given, the places of their ones in
    vectors of that size.  The risk of the negatives is what the unlabelled
    rows have beyond the positives' share.  Where it falls below zero, the
    step undoes that excess.
    """
    w = np.zeros((positive.shape[1] if size is None else size) + 1)
    w[-1] = np.log(prior / (1 - prior))
    if not len(positive) or not len(unlabelled):
        return w
    adam = Adam(len(w), rate)

    def values(x: np.ndarray) -> np.ndarray:
        return (x @ w[:-1] if size is None else w[:-1][x].sum(1)) + w[-1]

    def gradient(x: np.ndarray, e: np.ndarray) -> np.ndarray:
        own = e @ x if size is None else np.bincount(x.ravel(), np.repeat(e, x.shape[1]), size)
        return np.append(own, e.sum()) / len(x)

    for _ in range(steps):
        zp, zu = values(positive), values(unlabelled)
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = gradient(unlabelled, sigmoid(zu)) - prior * gradient(positive, sigmoid(zp))
        if negative_risk >= 0:
            g = prior * gradient(positive, sigmoid(zp) - 1) + negative
        else:
            g = -negative
        g[:-1] += l2 * w[:-1]
        adam.step(w, g)
    return w


@dataclass
class Bins:
    """Each feature as a one-hot bin between quantiles of the sample."""

    edges: list[np.ndarray]

    @classmethod
    def of(cls, sample: np.ndarray, bins: int = 32) -> Bins:
        if not len(sample):
            return cls([np.array([])] * sample.shape[1])
        return cls([np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in sample.T])

    @property
    def offsets(self) -> np.ndarray:
        return np.cumsum([0] + [len(e) + 1 for e in self.edges])

    def places(self, x: np.ndarray) -> np.ndarray:
        """For each row and feature the number of its bin, over all features."""
        out = np.empty(x.shape, np.int64)
        for j, (e, start) in enumerate(zip(self.edges, self.offsets)):
            out[:, j] = start + np.searchsorted(e, x[:, j], side="left")
        return out
