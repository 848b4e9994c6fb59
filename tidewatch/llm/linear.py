"""Linear models on small matrices, dense ones or marks, the same on every run."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def _descend(times, back, n: int, width: int, positive: np.ndarray, loss: str, l2: float, steps: int) -> np.ndarray:
    """Weights by accelerated gradient descent; ``times(w)`` and ``back(v)`` are the products with x and its transpose."""
    y = np.where(positive, 1.0, -1.0)
    shrink = np.full(width, l2)
    shrink[-1] = 0.0
    # The largest curvature: a bound on the largest eigenvalue of x'x / n by power iteration.
    v = np.ones(width, np.float32)
    size = 1.0
    for _ in range(20):
        v = back(times(v)) / n
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    step = 1.0 / ((0.25 if loss == "logistic" else 2.0) * size * 1.05 + l2)
    w = ahead = np.zeros(width)
    for k in range(steps):
        margin = y * times(ahead.astype(np.float32))
        pull = sigmoid(-margin) if loss == "logistic" else 2.0 * np.maximum(1.0 - margin, 0.0)
        after = ahead - step * (shrink * ahead - back((y * pull).astype(np.float32)) / n)
        ahead = after + k / (k + 3) * (after - w)
        w = after
    return w


def fit_linear(x: np.ndarray, positive: np.ndarray, loss: str, l2: float = 1e-3, steps: int = 150, even: bool = True) -> np.ndarray:
    """Weights and, last, the intercept, by accelerated gradient descent.

    ``loss`` is ``logistic`` or ``hinge`` (squared: a linear support vector
    machine).  The intercept is not held small.  With ``even``, inputs are brought
    to equal spread first, so that rare ones count as much as common ones.
    """
    spread = np.maximum(x.std(axis=0), 1e-2) if even else np.ones(x.shape[1])
    x = np.hstack([x / spread, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    w = _descend(lambda v: x @ v, lambda v: x.T @ v, len(x), x.shape[1], positive, loss, l2, steps)
    return w / np.append(spread, 1.0)


class Marks:
    """Rows of few marks among many, with some dense columns behind them: as a matrix, but only the ones are held."""

    def __init__(self, rows: np.ndarray, marks: np.ndarray, width: int, dense: np.ndarray):
        self.rows, self.marks, self.width, self.dense = rows, marks, width, dense

    def __len__(self) -> int:
        return len(self.dense)

    def with_column(self, values: np.ndarray) -> Marks:
        return Marks(self.rows, self.marks, self.width, np.hstack([self.dense, values[:, None]]))

    def only(self, chosen: np.ndarray) -> Marks:
        number = np.cumsum(chosen) - 1
        there = chosen[self.rows]
        return Marks(number[self.rows[there]], self.marks[there], self.width, self.dense[chosen])

    def times(self, w: np.ndarray) -> np.ndarray:
        """The product with weights of the marks and the dense columns."""
        ones = np.bincount(self.rows, weights=w[: self.width][self.marks], minlength=len(self))
        return ones + self.dense @ w[self.width:]

    def back(self, v: np.ndarray) -> np.ndarray:
        ones = np.bincount(self.marks, weights=v[self.rows], minlength=self.width)
        return np.concatenate((ones, self.dense.T @ v))

    def spread(self) -> np.ndarray:
        share = np.bincount(self.marks, minlength=self.width) / max(len(self), 1)
        return np.maximum(np.concatenate((np.sqrt(share * (1 - share)), self.dense.std(axis=0))), 1e-2)


def fit_marks(x: Marks, positive: np.ndarray, l2: float = 1e-3, steps: int = 150) -> np.ndarray:
    """As ``fit_linear`` with logistic loss, for marks."""
    spread = x.spread()
    w = _descend(
        lambda v: x.times(v[:-1] / spread) + v[-1],
        lambda v: np.append(x.back(v) / spread, v.sum()),
        len(x), len(spread) + 1, positive, "logistic", l2, steps,
    )
    return w / np.append(spread, 1.0)


def margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
