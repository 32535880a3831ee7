"""Iterations over the edges of one leaderboard, as array programs; an edge list is never made dense.

Edges are arrays (i, j, win, tie) with item numbers below k; each pair of items that met appears in both directions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Edges:
    k: int
    i: np.ndarray
    j: np.ndarray
    win: np.ndarray
    tie: np.ndarray

    def combine(self, win_weight: float, tie_weight: float, fill: float) -> np.ndarray:
        """Weight of each edge; NaN becomes `fill`."""
        with np.errstate(all="ignore"):
            return np.nan_to_num(win_weight * np.nan_to_num(self.win, nan=fill) + tie_weight * np.nan_to_num(self.tie, nan=fill), nan=fill)

    def back(self, weight: np.ndarray) -> np.ndarray:
        """Of each edge, the weight of its reverse."""
        key, rev = self.i * self.k + self.j, self.j * self.k + self.i
        order = np.argsort(key)
        return weight[order[np.searchsorted(key, rev, sorter=order)]]


def symmetric(k: int, i: np.ndarray, j: np.ndarray, win: np.ndarray, tie: np.ndarray) -> Edges:
    """Edges with every reverse present, each once, sorted."""
    key = np.concatenate([i * k + j, j * k + i])
    zero = np.zeros(len(i))
    keys, at = np.unique(key, return_inverse=True)
    size = len(keys)
    return Edges(k, keys // max(k, 1), keys % max(k, 1), np.bincount(at, np.concatenate([win, zero]), size), np.bincount(at, np.concatenate([tie, zero]), size))


def _close(new: np.ndarray, old: np.ndarray, tolerance: float) -> bool:
    with np.errstate(all="ignore"):
        return bool(np.sqrt(np.sum((new - old) ** 2)) < tolerance)


def bradley_terry(e: Edges, win_weight: float = 1.0, tie_weight: float = 0.5, tolerance: float = 1e-6, limit: int = 100) -> tuple[np.ndarray, int]:
    """Strengths with geometric mean 1. Items are updated in turn, each from those before it (Gauss-Seidel)."""
    a = e.combine(win_weight, tie_weight, tolerance)
    b = e.back(a)
    start = np.searchsorted(e.i, np.arange(e.k + 1))
    p = np.ones(e.k)
    for step in range(1, limit + 1):
        before = p.copy()
        with np.errstate(all="ignore"):
            for item in range(e.k):
                s = slice(start[item], start[item + 1])
                other = p[e.j[s]]
                both = p[item] + other
                p[item] = np.sum(a[s] * other / both) / np.sum(b[s] / both)
            p = np.nan_to_num(p / np.exp(np.mean(np.log(p))), nan=tolerance)
        if _close(p, before, tolerance):
            return p, step
    return p, limit if e.k else 0


def newman(e: Edges, win_weight: float = 1.0, tie_weight: float = 1.0, tolerance: float = 1e-6, limit: int = 100, v_init: float = 0.5) -> tuple[np.ndarray, float, int]:
    """Strengths and the draw parameter of the last step; all items at once from the step before (Jacobi)."""
    win, tie = win_weight * np.nan_to_num(e.win, nan=tolerance), tie_weight * np.nan_to_num(e.tie, nan=tolerance)
    half = win + tie / 2
    half_back = e.back(half)
    p, v, following = np.ones(e.k), v_init, v_init
    for step in range(1, limit + 1):
        v = float(np.nan_to_num(following, nan=tolerance))
        with np.errstate(all="ignore"):
            a, b = p[e.i], p[e.j]
            root = np.sqrt(a * b)
            under = a + b + 2 * v * root
            won = np.bincount(e.i, half * (b + v * root) / under, e.k)
            lost = np.bincount(e.i, half_back * (1 + v * np.sqrt(b / a)) / under, e.k)
            new = np.nan_to_num(won / lost, nan=tolerance)
            following = (np.sum(tie * (a + b) / under) / 2) / (2 * np.sum(win * root / under))
        near = _close(new, p, tolerance)
        p = new
        if near:
            return p, v, step
    return p, v, limit if e.k else 0


def _power(k: int, step, tolerance: float, limit: int) -> tuple[np.ndarray, int]:
    p = np.full(k, 1 / k) if k else np.zeros(0)
    for n in range(1, limit + 1 if k else 1):
        with np.errstate(all="ignore"):
            new = step(p)
            new = np.nan_to_num(new / (np.sqrt(np.sum(new**2)) or 1), nan=tolerance)
        near = _close(new, p, tolerance)
        p = new
        if near:
            return p, n
    return p, limit if k else 0


def eigen(e: Edges, win_weight: float = 1.0, tie_weight: float = 0.5, tolerance: float = 1e-6, limit: int = 100) -> tuple[np.ndarray, int]:
    """Leading eigenvector of the transposed matrix by power iteration: score flows from winners to losers."""
    a = e.combine(win_weight, tie_weight, tolerance)
    return _power(e.k, lambda p: np.bincount(e.j, a * p[e.i], e.k), tolerance, limit)


def pagerank(e: Edges, win_weight: float = 1.0, tie_weight: float = 0.5, damping: float = 0.85, tolerance: float = 1e-6, limit: int = 100) -> tuple[np.ndarray, int]:
    """Power iteration on damped losses: score flows from losers to winners, from an item that never lost to all alike. Scores add up to 1."""
    a = e.combine(win_weight, tie_weight, tolerance)
    lost = np.bincount(e.j, a, e.k)
    with np.errstate(all="ignore"):
        share = np.nan_to_num(a / lost[e.j])

    def step(p: np.ndarray) -> np.ndarray:
        flow = np.bincount(e.i, share * p[e.j], e.k) + p[lost == 0].sum() / e.k
        return damping * flow + (1 - damping) / e.k * p.sum()

    p, n = _power(e.k, step, tolerance, limit)
    norm = np.abs(p).sum()
    return (p / norm if norm else p), n


def counting(e: Edges, win_weight: float = 1.0, tie_weight: float = 0.5) -> np.ndarray:
    """Weighted wins and ties; a draw with oneself counts twice, as in the log."""
    return np.nan_to_num(np.bincount(e.i, win_weight * e.win + tie_weight * e.tie, e.k))


def average_win_rate(e: Edges, win_weight: float = 1.0, tie_weight: float = 0.5) -> np.ndarray:
    """Mean over opponents of the share won against each; 0 without opponents."""
    a = e.combine(win_weight, tie_weight, 0.0)
    b = e.back(a)
    met = a + b != 0
    rate = a[met] / (a + b)[met]
    n = np.bincount(e.i[met], minlength=e.k)
    return np.bincount(e.i[met], rate, e.k) / np.maximum(n, 1)
