"""FTRL-proximal logistic regression on sparse rows, trained in shards and mixed."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np


class Ftrl:
    """Per-coordinate rates and L1 sparsity; coordinate 0 is an unpenalised bias."""

    def __init__(self, dims: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(dims), np.zeros(dims)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 0, 0.0, self.l1)
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        """at: distinct coordinates."""
        w = self.weights(at)
        g = weight * (sigmoid(float(w @ x)) - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g

    def fit(self, rows: list[tuple], epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The coordinates whose weight is not zero, and those weights; rows are learn()'s arguments."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                self.learn(*rows[k])
        at = np.flatnonzero((np.abs(self.z) > self.l1) | (np.arange(len(self.z)) == 0))
        return at, self.weights(at)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def mixed(models: Iterable[tuple[int, list[int], list[float]]], drop: float = 0.01) -> dict[int, float]:
    """Averages (rows, coordinates, weights) by rows; weights under drop vanish."""
    total, weight_of = 0, {}
    for n, at, w in models:
        total += n
        for i, v in zip(at, w, strict=True):
            weight_of[i] = weight_of.get(i, 0.0) + n * v
    return {i: v / total for i, v in weight_of.items() if i == 0 or abs(v) >= drop * total}
