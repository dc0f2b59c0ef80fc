"""k-means with D-squared seeding."""

from __future__ import annotations

import numpy as np

_ROWS = 8192


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None, :], 0)


def kmeans(x: np.ndarray, k: int, iterations: int = 20, seed: int = 0) -> np.ndarray:
    """k centroids.  Fewer samples than k are repeated, none gives zeros; an empty
    cluster restarts at the sample farthest from its centroid; the loop ends once
    under one per cent of the samples change cluster."""
    n, dim = x.shape
    if n == 0:
        return np.zeros((k, dim))
    if n < k:
        return x[np.arange(k) % n].astype(np.float64)
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    centre = np.empty((k, dim))
    centre[0] = x[rng.integers(n)]
    nearest = ((x - centre[0]) ** 2).sum(axis=1)
    for j in range(1, k):
        total = nearest.sum()
        centre[j] = x[rng.choice(n, p=nearest / total)] if total > 0 else x[rng.integers(n)]
        np.minimum(nearest, ((x - centre[j]) ** 2).sum(axis=1), out=nearest)
    before = np.full(n, -1)
    for _ in range(iterations):
        label, loss = np.empty(n, np.int64), np.empty(n)
        for i in range(0, n, _ROWS):  # never the whole table of distances
            d = squared(x[i : i + _ROWS], centre)
            label[i : i + _ROWS] = d.argmin(axis=1)
            loss[i : i + _ROWS] = d.min(axis=1)
        size = np.bincount(label, minlength=k)
        sums = np.zeros((k, dim))
        np.add.at(sums, label, x)
        full = size > 0
        centre[full] = sums[full] / size[full, None]
        far = np.argsort(-loss, kind="stable")
        for j, i in zip(np.flatnonzero(~full), far, strict=False):
            centre[j] = x[i]
        changed = int((label != before).sum())
        before = label
        if full.all() and changed < 0.01 * n:
            break
    return centre
