"""Penalised logistic regression by Newton steps that never raise the loss."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 100) -> np.ndarray:
    """Weights for labels 0 and 1.

    The loss is strictly convex. A step is halved until the loss falls enough, so
    separable labels, which make plain Newton steps run away, come to rest too.
    """
    w = np.zeros(x.shape[1])

    def loss(v):
        z = x @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + penalty / 2 * v @ v)

    current = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        falls, size = float(gradient @ step), 1.0
        while (new := loss(w - size * step)) > current - 1e-4 * size * falls and size > 1e-8:
            size /= 2
        if new >= current:
            break
        w, gain, current = w - size * step, current - new, new
        if gain < 1e-9 * (1 + abs(current)):
            break
    return w
