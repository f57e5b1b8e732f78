"""Ratios by plain counting, and dual coordinate descent against a slow exact solver."""

import math
from collections import Counter

import numpy as np
import pytest

from ledgermatch.llm import linear
from ledgermatch.llm.features import DIMENSIONS, Rows


def made(seed, count=40, width=15):
    rng = np.random.default_rng(seed)
    lists = [np.unique(rng.integers(0, width, rng.integers(1, 8))) for _ in range(count)]
    rows = Rows(np.concatenate(lists).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in lists])]))
    y = np.where([(3 in x) != (rng.random() < 0.2) for x in lists], 1.0, -1.0)
    return lists, rows, y, rng


def test_ratios_are_those_of_plain_counts():
    lists, rows, y, _ = made(1)
    found = linear.log_count_ratios(rows, y, smooth=1.0)
    counts = {s: Counter(int(i) for x, v in zip(lists, y, strict=True) if v == s for i in x) for s in (1.0, -1.0)}
    total = {s: sum(c.values()) + DIMENSIONS for s, c in counts.items()}
    for i in (*range(15), 777):
        expected = math.log((counts[1.0][i] + 1) / total[1.0]) - math.log((counts[-1.0][i] + 1) / total[-1.0])
        assert found[i] == pytest.approx(expected)


@pytest.mark.parametrize("seed", range(4))
def test_dual_coordinate_descent_reaches_the_optimum(seed, monkeypatch):
    """Against projected gradient steps on the dual, many and small."""
    monkeypatch.setattr(linear, "SETTLED", 1e-12)
    lists, rows, y, rng = made(seed)
    scale, more, cost = rng.uniform(0.5, 2, DIMENSIONS), rng.standard_normal((len(lists), 2)), 0.3
    w, v = linear.support_vectors(rows, scale, more, y, cost=cost, rounds=5000)
    x = np.zeros((len(lists), 15))
    for k, own in enumerate(lists):
        x[k, own] = scale[own]
    x = np.concatenate([x, more], axis=1) * y[:, None]
    gram = x @ x.T
    dual, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(200_000):
        dual = np.clip(dual - step * (gram @ dual - 1), 0, cost)
    weights = x.T @ dual
    got = np.concatenate([w[:15] / scale[:15], v])
    assert got == pytest.approx(weights, abs=1e-4)

    def loss(u):
        return 0.5 * u @ u + cost * np.maximum(0, 1 - x @ u).sum()

    assert loss(got) <= loss(weights) + 1e-6 and all(loss(got) <= loss(got + rng.standard_normal(17) * 0.01) for _ in range(50))
