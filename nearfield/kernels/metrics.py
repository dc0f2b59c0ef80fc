"""Distances between rows of two matrices, as indexes rank them: smaller is nearer."""

from __future__ import annotations

import numpy as np


def pairwise(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """(rows of a, rows of b): squared l2, 1 - cosine (1 at a zero norm) or the negated inner product."""
    if metric == "l2sq":
        out = np.empty((len(a), len(b)))
        step = max(1, (16 << 20) // max(1, 8 * b.size))
        for i in range(0, len(a), step):  # differences, not the expanded square: near zero that cancels
            out[i : i + step] = ((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        return out
    dot = a @ b.T
    if metric == "ip":
        return -dot
    norm = np.sqrt((a**2).sum(axis=1))[:, None] * np.sqrt((b**2).sum(axis=1))[None, :]
    return 1 - np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    norm = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
