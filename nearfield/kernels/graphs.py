"""Proximity graphs over the rows of one shard: layered (HNSW) and single-layer (Vamana)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable

import numpy as np

Distance = Callable[[np.ndarray], np.ndarray]


def beam(start: Iterable[int], neighbours: Callable[[int], np.ndarray], distance: Distance, width: int, n: int) -> list[tuple[float, int]]:
    """The ``width`` nearest rows that a best-first walk finds, nearest first; it
    ends when the best open row is farther than the worst of a full result."""
    visited = np.zeros(n, bool)
    first = np.array(list(start))
    visited[first] = True
    d = distance(first)
    todo = [(float(x), int(i)) for x, i in zip(d, first, strict=True)]
    heapq.heapify(todo)
    found = [(-x, -i) for x, i in todo]
    heapq.heapify(found)
    while todo:
        x, i = heapq.heappop(todo)
        if len(found) >= width and x > -found[0][0]:
            break
        near = neighbours(i)
        near = near[~visited[near]]
        if not len(near):
            continue
        visited[near] = True
        for y, j in zip(distance(near).tolist(), near.tolist(), strict=True):
            if len(found) < width:
                heapq.heappush(found, (-y, -j))
                heapq.heappush(todo, (y, j))
            elif y < -found[0][0]:
                heapq.heapreplace(found, (-y, -j))
                heapq.heappush(todo, (y, j))
    return sorted((-x, -i) for x, i in found)


def diverse(candidates: list[tuple[float, int]], between: Callable[[int, np.ndarray], np.ndarray], limit: int, alpha: float = 1.0, strict: bool = True) -> list[int]:
    """Nearest first, each unless one that was taken before is nearer to it than the query is (``alpha`` times)."""
    if not candidates:
        return []
    ids = np.array([i for _, i in candidates])
    own = np.array([d for d, _ in candidates])
    alive = np.ones(len(ids), bool)
    taken: list[int] = []
    for j in range(len(ids)):
        if not alive[j]:
            continue
        taken.append(int(ids[j]))
        if len(taken) == limit:
            break
        rest = np.flatnonzero(alive[j + 1 :]) + j + 1
        if len(rest):
            d = alpha * between(int(ids[j]), ids[rest])
            alive[rest[d < own[rest] if strict else d <= own[rest]]] = False
    return taken


def join_up(edges: Callable[[int], np.ndarray], add: Callable[[int, int], None], entry: int, x: np.ndarray, pairwise: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Edges to what no walk from ``entry`` reaches: pruning may cut off rows in tight groups.
    Each gets one from the nearest row that is reached."""
    reached = np.zeros(len(x), bool)

    def spread(i: int) -> None:
        reached[i], todo = True, [i]
        while todo:
            near = edges(todo.pop())
            near = near[~reached[near]]
            reached[near] = True
            todo.extend(near.tolist())

    spread(entry)
    for i in np.flatnonzero(~reached).tolist():
        if not reached[i]:
            known = np.flatnonzero(reached)
            add(int(known[pairwise(x[i : i + 1], x[known])[0].argmin()]), i)
            spread(i)


class Layered:
    """HNSW: each row on ``floor(-ln(U) / ln(M))`` upper layers.

    Where the diverse neighbours leave places free, the nearest others take them.
    """

    def __init__(self, m: int = 16, m0: int | None = None, ef_construction: int = 100, max_level: int = 8, seed: int = 7) -> None:
        self.m, self.m0 = m, m0 or 2 * m
        self.ef, self.max_level, self.seed = max(ef_construction, m), max_level, seed
        self.layers: list[dict[int, np.ndarray]] = []
        self.entry, self.n = -1, 0

    def build(self, x: np.ndarray, pairwise: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        self.n = len(x)
        draws = np.random.default_rng(self.seed).random(len(x))
        levels = np.minimum(np.floor(-np.log(np.maximum(draws, 1e-12)) / math.log(max(2, self.m))), self.max_level).astype(int)
        between = lambda i, js: pairwise(x[i : i + 1], x[js])[0]
        for i in range(len(x)):
            self._insert(i, int(levels[i]), lambda js, i=i: between(i, js), between)

    def _near(self, layer: int) -> Callable[[int], np.ndarray]:
        graph = self.layers[layer]
        none = np.zeros(0, np.int64)
        return lambda i: graph.get(i, none)

    @staticmethod
    def _chosen(candidates: list[tuple[float, int]], between: Callable, limit: int) -> list[int]:
        taken = diverse(candidates, between, limit)
        own = set(taken)
        return taken + [i for _, i in candidates if i not in own][: limit - len(taken)]

    def _insert(self, i: int, level: int, distance: Distance, between: Callable) -> None:
        top = len(self.layers) - 1
        at = [self.entry]
        if self.entry >= 0:
            for layer in range(top, level, -1):
                at = [beam(at, self._near(layer), distance, 1, self.n)[0][1]]
        for layer in range(min(level, top), -1, -1):
            found = beam(at, self._near(layer), distance, self.ef, self.n)
            limit = self.m0 if layer == 0 else self.m
            chosen = self._chosen(found, between, self.m)
            self.layers[layer][i] = np.array(chosen, np.int64)
            for j in chosen:
                others = np.append(self.layers[layer].get(j, np.zeros(0, np.int64)), i)
                if len(others) > limit:
                    d = between(j, others)
                    others = np.array(self._chosen(sorted(zip(d.tolist(), others.tolist(), strict=True)), between, limit), np.int64)
                self.layers[layer][j] = others
            at = [j for _, j in found]
        while len(self.layers) <= level:
            self.layers.append({i: np.zeros(0, np.int64)})
            self.entry = i

    def join_up(self, x: np.ndarray, pairwise: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        if self.n:
            join_up(self._near(0), lambda i, j: self.layers[0].update({i: np.append(self._near(0)(i), j)}), self.entry, x, pairwise)

    def search(self, distance: Distance, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            at = [beam(at, self._near(layer), distance, 1, self.n)[0][1]]
        return beam(at, self._near(0), distance, max(ef, k), self.n)[:k]


class Vamana:
    """One layer, entered at the first row; edges by robust pruning with ``alpha``."""

    def __init__(self, degree: int = 64, width: int = 100, alpha: float = 1.2) -> None:
        self.degree, self.width, self.alpha = degree, max(width, degree), alpha
        self.edges: list[np.ndarray] = []
        self.n = 0

    def build(self, x: np.ndarray, pairwise: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        self.n = len(x)
        self.edges = [np.zeros(0, np.int64) for _ in range(len(x))]
        between = lambda i, js: pairwise(x[i : i + 1], x[js])[0]
        for i in range(1, len(x)):
            found = beam([0], self.edges.__getitem__, lambda js, i=i: between(i, js), self.width, self.n)
            chosen = diverse([c for c in found if c[1] != i], between, self.degree, self.alpha, False)
            self.edges[i] = np.array(chosen, np.int64)
            for j in chosen:
                others = np.append(self.edges[j], i)
                if len(others) > self.degree:
                    d = between(j, others)
                    others = np.array(diverse(sorted(zip(d.tolist(), others.tolist(), strict=True)), between, self.degree, self.alpha, False), np.int64)
                self.edges[j] = others

    def join_up(self, x: np.ndarray, pairwise: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        def add(i: int, j: int) -> None:
            self.edges[i] = np.append(self.edges[i], j)

        if self.n:
            join_up(self.edges.__getitem__, add, 0, x, pairwise)

    def search(self, distance: Distance, k: int, width: int) -> list[tuple[float, int]]:
        return beam([0], self.edges.__getitem__, distance, max(width, k), self.n)[:k] if self.n else []
