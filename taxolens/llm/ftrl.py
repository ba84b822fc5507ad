"""Logistic regression by follow-the-regularised-leader updates, on sparse rows.

Each coordinate keeps a sum of adjusted gradients z and of squared gradients n;
the weight is the closed-form minimiser under L1 and L2, with a learning rate of
its own that falls as n grows (McMahan et al., "Ad click prediction: a view from
the trenches", KDD 2013).  Rows are taken one at a time in a fixed order, so the
same rows give the same model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Ftrl:
    bits: int = 20
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    epochs: int = 4
    min_updates: int = 0  # few rows are gone through more often, up to so many updates in all
    positive: float = 1.0  # how much a row of label 1 counts
    seed: int = 7

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.sign(z) * self.l1 - z
        w /= (self.beta + np.sqrt(n)) / self.alpha + self.l2
        w[np.abs(z) <= self.l1] = 0.0
        return w

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
        """Weights; the last one, which L1 doesn't touch, is the bias."""
        size = (1 << self.bits) + 1
        z, n = np.zeros(size), np.zeros(size)
        bias = size - 1
        turn = np.random.default_rng(self.seed)
        for _ in range(max(self.epochs, -(-self.min_updates // max(len(rows), 1)))):
            for i in turn.permutation(len(rows)):
                idx, val = rows[i]
                w = self.weights(z[idx], n[idx])
                b = -z[bias] / ((self.beta + np.sqrt(n[bias])) / self.alpha)
                p = 1.0 / (1.0 + np.exp(-np.clip(w @ val + b, -35, 35)))
                off = (p - labels[i]) * (self.positive if labels[i] else 1.0)
                g = off * val
                s = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / self.alpha
                z[idx] += g - s * w
                n[idx] += g * g
                g = off
                s = (np.sqrt(n[bias] + g * g) - np.sqrt(n[bias])) / self.alpha
                z[bias] += g - s * b
                n[bias] += g * g
        w = self.weights(z, n)
        w[bias] = -z[bias] / ((self.beta + np.sqrt(n[bias])) / self.alpha)
        return w


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))
