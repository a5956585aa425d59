"""A graph's links as index arrays, and sums over all pairs of nodes tile by tile: an autoencoder's steps without dense matrices.

Memory grows with nodes and links. The sums look at every pair; run() may spread blocks of rows over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from graphloom.gnn.tape import Value

#: Rows and columns of a tile, which stays in a core's cache; rows of a block, the least that a task takes.
ROWS, COLUMNS, BLOCK = 64, 1024, 512
EPS = 1e-10  # as in binary_cross_entropy


def sigmoid_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of x: the sum over the rows of y of the sigmoid of their inner product."""
    out = np.zeros(len(x))
    for r in range(0, len(x), ROWS):
        part = -x[r : r + ROWS]
        for c in range(0, len(y), COLUMNS):
            s = part @ y[c : c + COLUMNS].T
            np.exp(np.clip(s, -500, 500, out=s), out=s)
            s += 1
            out[r : r + ROWS] += np.reciprocal(s, out=s).sum(1)
    return out


def _probabilities(z: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For rows lo to hi: the sum of p over all columns, where p is the sigmoid of the rows' inner product."""
    return sigmoid_sums(z[lo:hi], z)[:, None]


def _slopes(z: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For rows lo to hi, over all columns: the sum of z by p * (1 - p) / (1 - p + EPS), and that of log(1 - p + EPS)."""
    k = z.shape[1]
    out = np.zeros((hi - lo, k + 1))
    for r in range(lo, hi, ROWS):
        x, at = z[r : min(r + ROWS, hi)], slice(r - lo, min(r + ROWS, hi) - lo)
        for c in range(0, len(z), COLUMNS):
            y = z[c : c + COLUMNS]
            u = x @ y.T
            np.exp(np.clip(u, -300, 300, out=u), out=u)
            u += 1  # 1 / (1 - p)
            t = u * EPS
            t += 1
            v = u / t  # 1 / (1 - p + EPS), from 1 to 1e10: logarithms are taken of products of 16
            cut = v.shape[1] // 16 * 16
            out[at, k] -= np.log(v[:, :cut].reshape(len(x), 16, -1).prod(1)).sum(1) + np.log(v[:, cut:]).sum(1)
            t *= u
            u -= 1
            u /= t
            out[at, :k] += u @ y
    return out


def here(f: Callable, z: np.ndarray) -> np.ndarray:
    """f over all rows in this process."""
    return f(z, 0, len(z))


class Links:
    """The cells (i, j) that are 1 in a symmetric adjacency of n nodes, in order; given in either direction or both, however often."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, run: Callable[[Callable, np.ndarray], np.ndarray] = here):
        i, j = np.asarray(i, np.int64), np.asarray(j, np.int64)
        cells = np.unique(np.r_[i * n + j, j * n + i])
        self.n, self.i, self.j, self.run = n, cells // max(n, 1), cells % max(n, 1), run
        a, b = np.r_[self.i, np.arange(n)], np.r_[self.j, np.arange(n)]  # with self loops
        order = np.argsort(a, kind="stable")
        d = 1 / np.sqrt(np.bincount(a, minlength=n))
        self._first, self._to = np.searchsorted(a[order], np.arange(n)), b[order]
        self._v = d[a[order], None] * d[self._to, None]

    def __len__(self) -> int:
        return self.n

    def _times(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self._v * x[self._to], self._first, 0) if self.n else x

    def spread(self, h: Value) -> Value:
        """The symmetric normalisation with self loops, times h."""
        return Value(self._times(h.data), (h,), lambda g: (self._times(g),))

    def _p(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((z[self.i] * z[self.j]).sum(1), -500, 500)))

    def entropy(self, z: Value, weight: float) -> Value:
        """binary_cross_entropy(sigmoid(z @ z.T), adjacency, weight)."""
        k, size = z.data.shape[1], float(self.n) ** 2
        got, p = self.run(_slopes, z.data), self._p(z.data)
        loss = -(got[:, k].sum() + (weight * np.log(p + EPS) - np.log(1 - p + EPS)).sum()) / size
        on = -p * (1 - p) * (weight / (p + EPS) + 1 / (1 - p + EPS))
        slope = got[:, :k].copy()
        for c in range(k):
            slope[:, c] += np.bincount(self.i, on * z.data[self.j, c], self.n)
        return Value(loss, (z,), lambda g: (g * 2 / size * slope,))

    def errors(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's mean of |adjacency - p| over all nodes, and each cell's own."""
        p = self._p(z)
        return (self.run(_probabilities, z)[:, 0] + np.bincount(self.i, 1 - 2 * p, self.n)) / max(self.n, 1), 1 - p
