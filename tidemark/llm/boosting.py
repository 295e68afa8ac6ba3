"""Small gradient-boosted trees over binned features, and isotonic calibration, on arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Boosted:
    """Complete trees of one depth: (feature, edge) per inner node, a value per leaf."""

    base: float
    features: np.ndarray  # trees x inner nodes
    edges: np.ndarray
    leaves: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for features, edges, leaves in zip(self.features, self.edges, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaves)))):
                node = 2 * node + 1 + (x[rows, features[node]] > edges[node])
            total += leaves[node - (len(leaves) - 1)]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> Boosted:
    """Logistic loss, second-order gains over quantile bins. Deterministic."""
    inner, n = 2**depth - 1, len(y)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    coded = np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)]) if x.shape[1] else np.zeros((n, 0), int)
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = float(np.log(mean / (1 - mean)))
    total = np.full(n, base)
    out = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = sigmoid(total)
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.zeros(width)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                k = len(c) + 1
                cell = local * k + coded[:, j]
                g = np.bincount(cell, grad, width * k).reshape(width, k).cumsum(1)
                h = np.bincount(cell, hess, width * k).reshape(width, k).cumsum(1)
                gl, hl, ga, ha = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < 1) | (ha - hl < 1)] = 0
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(width), top] > best + 1e-9):
                    best[i] = gain[i, top[i]]
                    out[0][t, first + i], out[1][t, first + i] = j, c[top[i]]
            node = 2 * node + 1 + (x[np.arange(n), out[0][t, node]] > out[1][t, node])
        local = node - inner
        g, h = np.bincount(local, grad, inner + 1), np.bincount(local, hess, inner + 1)
        out[2][t] = rate * g / (h + ridge)
        total += out[2][t, local]
    return Boosted(base, *out)


@dataclass
class Isotonic:
    """A rising step function's centres, joined by lines."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)


def isotonic(x: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each pooled block counts at its mean margin."""
    at, of = np.unique(x, return_inverse=True)  # equal margins are one block
    counts = np.bincount(of).astype(float)
    blocks: list[list[float]] = []  # sum of y, of x, count
    for a, b, c in zip(at.tolist(), np.bincount(of, y).tolist(), counts.tolist(), strict=True):
        blocks.append([b, a * c, c])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks)
    return Isotonic(table[:, 1] / table[:, 2], table[:, 0] / table[:, 2])
