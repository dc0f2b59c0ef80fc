"""One-permutation MinHash with optimal densification.

Every shingle hash is looked at once: its high part names a bin, and the bin
keeps the smallest hash that falls into it.  An empty bin then borrows from a
bin that is not empty, chosen by a random order of all bins that belongs to the
empty bin alone (the first non-empty bin of its order).  So each empty bin
chooses on its own, and likewise for all documents.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from nearfield.llm.kernels import GOLDEN, U64, mix64

_FEW = 48
_STEP = 16


@lru_cache(maxsize=8)
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin its order of all bins, and the rank of each bin in it."""
    cells = np.arange(bins * bins, dtype=U64).reshape(bins, bins)
    order = np.argsort(mix64((cells + U64(1)) * GOLDEN), axis=1, kind="stable").astype(np.int32)
    rank = np.empty((bins, bins), np.int32)
    np.put_along_axis(rank, order, np.arange(bins, dtype=np.int32)[None, :], axis=1)
    return order, rank


def bin_of(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Which bin each hash falls into: its place in ``bins`` equal ranges."""
    return ((hashes >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The densified bin minima of a sorted, non-empty set of hashes."""
    which = bin_of(hashes, bins)
    first = np.flatnonzero(np.diff(which, prepend=-1))
    values = np.zeros(bins, U64)
    occupied = which[first]
    values[occupied] = hashes[first]  # sorted hashes: the first of a bin is its smallest
    if len(occupied) == bins:
        return values
    filled = np.zeros(bins, bool)
    filled[occupied] = True
    empty = np.flatnonzero(~filled)
    order, rank = _orders(bins)
    if len(occupied) <= _FEW:
        values[empty] = values[occupied[rank[np.ix_(empty, occupied)].argmin(axis=1)]]
        return values
    found = values.copy()
    at = 0
    while len(empty):
        tried = order[empty, at : at + _STEP]
        hit = filled[tried]
        best = hit.argmax(axis=1)
        rows = np.arange(len(empty))
        ok = hit[rows, best]
        found[empty[ok]] = values[tried[rows, best][ok]]
        empty = empty[~ok]
        at += _STEP
    return found


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A key for each row of signatures and each band of consecutive bins."""
    rows = signatures.shape[1] // bands
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * GOLDEN, (len(signatures), bands))
    for j in range(rows):
        keys = mix64(keys ^ parts[:, :, j])
    return keys
