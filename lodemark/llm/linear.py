"""A linear hinge-loss model fitted by dual coordinate descent."""

from __future__ import annotations

import numpy as np


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of sparse ``rows`` (indices, values) for y of -1 and 1.

    Minimises |w|^2 / 2 + sum of cost * hinge through its dual, one coordinate at a time.
    """
    w, a = np.zeros(dim + 1), np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            k, v = rows[i]
            gradient = y[i] * (w[k] @ v + w[-1]) - 1.0
            new = min(max(a[i] - gradient / norms[i], 0.0), cost[i])
            if (change := (new - a[i]) * y[i]) != 0.0:
                w[k] += change * v
                w[-1] += change
                a[i] = new
    return w


def scores(rows, w: np.ndarray) -> np.ndarray:
    return np.array([float(w[k] @ v) + w[-1] for k, v in rows])


def calibrate(margins: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets."""
    up, down = float((y > 0).sum()), float((y <= 0).sum())
    if not up or not down:
        return 1.0, 0.0
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum(), (p - t).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margins**2).sum() + 1e-6, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-7:
            break
    return (a, b) if a > 0 else (1.0, b)
