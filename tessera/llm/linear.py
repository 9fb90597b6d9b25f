"""A linear hinge-loss model by dual coordinate descent, and a probability for its margin.

Used on bounded samples only; see ``common.bounded_sample``.
"""

from __future__ import annotations

import numpy as np


def fit_hinge(rows: list[tuple[np.ndarray | slice, np.ndarray]], y: np.ndarray, n_features: int, cost: float = 1.0, passes: int = 30, seed: int = 5, class_weights: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Weights (the last is the bias) of the L1-loss support vector machine.

    ``rows``: (feature numbers or their slice, values) of each example; ``y``: +1 or -1.
    One dual variable a step: its gradient, clipped to [0, cost].
    """
    w = np.zeros(n_features + 1)
    alpha = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    upper = np.where(y > 0, cost * class_weights[1], cost * class_weights[0])
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            slope = y[i] * (w[at] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / norms[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                worst = max(worst, abs(step) * norms[i])
                alpha[i] = new
                w[at] += step * v
                w[-1] += step
        if worst < 1e-3:
            break
    return w


def fit_sigmoid(x: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, shift) of P(label = 1) = 1 / (1 + exp(-(slope * x + shift))), by Newton steps on smoothed labels."""
    n1, n0 = float(label.sum()), float(len(label) - label.sum())
    goal = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.ones(len(x)) if weight is None else weight
    mean, scale = (float(x.mean()), float(x.std()) or 1.0) if len(x) else (0.0, 1.0)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    theta = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -35, 35)))
        grad = z.T @ (weight * (p - goal)) + ridge * theta * [1, 0]
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([ridge, 1e-9])
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0] / scale), float(theta[1] - theta[0] * mean / scale)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
