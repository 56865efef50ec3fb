"""Small numeric routines in numpy: sparse products, Adam, hashing."""

from __future__ import annotations

import numpy as np


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i] : starts[i + 1]]."""
    out = np.zeros(len(starts) - 1)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values, starts[full])
    return out


class Sparse:
    """A sparse matrix by rows, and again by columns: entries of value 1 or ``data``."""

    def __init__(self, starts: np.ndarray, cols: np.ndarray, width: int, data: np.ndarray | None = None):
        self.starts, self.cols, self.width, self.data = starts, cols.astype(np.int32), width, data
        self.rows = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
        order = np.argsort(self.cols, kind="stable")
        self.by_column = self.rows[order], np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=width))]), None if data is None else data[order]

    def dot(self, x: np.ndarray) -> np.ndarray:
        return segment_sums(x[self.cols] if self.data is None else self.data * x[self.cols], self.starts)

    def t_dot(self, y: np.ndarray) -> np.ndarray:
        rows, starts, data = self.by_column
        return segment_sums(y[rows] if data is None else data * y[rows], starts)

    def columns(self, keep: np.ndarray) -> Sparse:
        """The same matrix without the entries of columns that aren't kept."""
        own = keep[self.cols]
        counts = np.bincount(self.rows[own], minlength=len(self.starts) - 1)
        return Sparse(np.concatenate([[0], np.cumsum(counts)]), self.cols[own], self.width, None if self.data is None else self.data[own])


def csr(lists: list[np.ndarray], width: int, data: np.ndarray | None = None) -> Sparse:
    sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    return Sparse(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(lists) if lists else np.zeros(0, np.int32), width, data)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(z, float)))


class Adam:
    """Adam steps over a list of arrays, updated in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
