"""Small linear models, fitted with numpy on bounded matrices."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of ridge logistic regression by Newton's steps; the last is the bias, which is not shrunk."""
    x = np.c_[x, np.ones(len(x))]
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (p - y) + shrink * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared hinge loss; y is -1 or 1."""
    x = np.c_[x, np.ones(len(x))]
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    w = np.zeros(x.shape[1])
    before = None
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        if before is not None and (inside == before).all():
            break
        before, s = inside, x[inside]
        w = np.linalg.solve((s * weight[inside][:, None]).T @ s + np.diag(shrink), s.T @ (weight[inside] * y[inside]))
    return w
