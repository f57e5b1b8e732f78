"""Linear models on naive Bayes features: log-count ratios, hinge loss, probabilities."""

from __future__ import annotations

import numpy as np

from ledgermatch.llm.features import Rows, sigmoid

#: Added to counts; cost of a margin below 1; rounds over the sample.
SMOOTH = 1.0
COST = 0.05
ROUNDS = 12
#: A round that moves no dual variable by more than this share of the cost is the last.
SETTLED = 0.01


def log_count_ratios(rows: Rows, y: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    one, zero = rows.back((y > 0).astype(float)) + smooth, rows.back((y <= 0).astype(float)) + smooth
    return np.log(one / one.sum()) - np.log(zero / zero.sum())


def support_vectors(
    rows: Rows, scale: np.ndarray, more: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """Weights of min 1/2 |w|^2 + sum cost * max(0, 1 - y w x) by dual coordinate descent, where x is the
    scaled indicators and the columns ``more``. The weights of indicators come multiplied by ``scale``."""
    w, v, dual = np.zeros(len(scale)), np.zeros(more.shape[1]), np.zeros(len(rows))
    norms = np.maximum(rows.dot(scale**2), 0) + (more**2).sum(axis=1)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for k in order.permutation(len(rows)):
            ids = rows.row(k)
            x = scale[ids]
            slope = y[k] * (w[ids] @ x + v @ more[k]) - 1
            new = min(max(dual[k] - slope / norms[k], 0.0), cost)
            if new != dual[k]:
                most = max(most, abs(new - dual[k]))
                step = (new - dual[k]) * y[k]
                w[ids] += step * x
                v += step * more[k]
                dual[k] = new
        if most < SETTLED * cost:
            break
    return w * scale, v


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of label 1 by margin, by Newton steps on smoothed labels."""
    ones, zeros = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    at = np.array([1.0, np.log((ones + 1) / (zeros + 1))])
    for _ in range(50):
        p = sigmoid(x @ at)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - goal) + 1e-6 * at)
        at = at - np.clip(step, -2, 2)
    return float(at[0]), float(at[1])
