"""Small numeric tools that the text classifiers share."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (last: intercept) of a ridge-penalised logistic regression, by Newton steps; ``weight``: of each row."""
    each = np.ones(len(x)) if weight is None else weight
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * each.sum())
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (each * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (each * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def folds(n: int, k: int, seed: int) -> np.ndarray:
    """A fold number for each of ``n`` rows."""
    return np.random.Generator(np.random.PCG64(seed)).permutation(n) % k
