"""Vector quantizers.

Each is trained on a sample, turns rows into fixed-size byte codes, estimates
the distance of a query to codes, and can rebuild an approximate row (for
distances between codes).  Estimates are of the index's kind of distance:
squared l2, 1 - cosine, negated inner product.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np

from nearfield.kernels.kmeans import kmeans, squared
from nearfield.kernels.metrics import pairwise, unit


class Quantizer:
    """The base class; ``state`` holds the arrays that training made."""

    name = ""
    metrics: tuple[str, ...] = ("l2sq", "cosine", "ip")
    compresses = True

    def __init__(self, dim: int, metric: str) -> None:
        if metric not in self.metrics:
            raise ValueError(f"{self.name} quantizer does not support {metric}")
        self.dim, self.metric = dim, metric
        self.state: dict[str, np.ndarray] = {}

    def train(self, x: np.ndarray) -> None:
        pass

    def code_size(self) -> int:
        raise NotImplementedError

    def encode(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def decode(self, codes: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def estimate(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def estimator(self, query: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """``estimate`` of one query, for the many small calls of a walk."""
        return lambda codes: self.estimate(query[None, :], codes)[0]

    def slack(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each row lies from what its code stands for."""
        return np.sqrt(((self._prepared(x) - self.decode(codes)) ** 2).sum(axis=1))

    def least(self, queries: np.ndarray, codes: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """What each row's distance (l2 not squared) is at least, by the triangle inequality."""
        q, x = self._prepared(queries), self.decode(codes)
        near, dot = slack * (1 + 1e-9), q @ x.T
        qq, xx = (q**2).sum(axis=1)[:, None], (x**2).sum(axis=1)[None, :]
        blur = 1e-12 * (qq + xx)  # rounding
        if self.metric == "l2sq":
            return np.sqrt(np.maximum(qq + xx - 2 * dot - blur, 0)) - near
        return (self.metric == "cosine") - dot - np.sqrt(qq) * near - blur

    def _prepared(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        return unit(x) if self.metric == "cosine" else x


class Flat(Quantizer):
    """The float32 vector itself."""

    name, compresses = "flat", False

    def code_size(self) -> int:
        return 4 * self.dim

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x, "<f4").view(np.uint8).reshape(len(x), -1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes).view("<f4").astype(np.float64).reshape(len(codes), self.dim)

    def estimate(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return pairwise(np.asarray(queries, np.float64), self.decode(codes), self.metric)


class RaBitQ(Quantizer):
    """Randomly rotated residuals in ``bits`` bits a dimension, with three floats to correct estimates.

    With one bit a code holds the signs, the residual's length and its inner
    product with the sign vector; with more, signed steps and the step's size.
    """

    name = "rabitq"
    BITS = (1, 2, 3, 4, 5, 7, 8)

    def __init__(self, dim: int, metric: str, bits: int = 3, seed: int = 42) -> None:
        super().__init__(dim, metric)
        if bits not in self.BITS:
            raise ValueError(f"rabitq bits must be one of {self.BITS}, not {bits}")
        if bits < 3:
            warnings.warn(f"rabitq with {bits} bit(s) needs a large rerank multiple", stacklevel=3)
        self.bits = bits
        self.state["rotation"] = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
        self.state["centroid"] = np.zeros(dim)

    def train(self, x: np.ndarray) -> None:
        if len(x):
            self.state["centroid"] = self._prepared(x).mean(axis=0)

    def code_size(self) -> int:
        return -(-self.dim * self.bits // 8) + 12

    def encode(self, x: np.ndarray) -> np.ndarray:
        centroid = self.state["centroid"]
        shifted = self._prepared(x) - centroid
        r = shifted @ self.state["rotation"].T
        length = np.sqrt((r**2).sum(axis=1))
        if self.bits == 1:
            levels = (r > 0).astype(np.uint8)
            direction = np.divide(r, length[:, None], out=np.zeros_like(r), where=length[:, None] > 0)
            second = (direction * np.where(levels, 1.0, -1.0)).sum(axis=1) / np.sqrt(self.dim)
        else:
            top = (1 << (self.bits - 1)) - 0.5
            second = np.abs(r).max(axis=1) / top
            step = np.where(second > 0, second, 1)[:, None]
            levels = np.clip(np.rint(r / step), -(1 << (self.bits - 1)), (1 << (self.bits - 1)) - 1).astype(np.int64)
            levels = (levels & ((1 << self.bits) - 1)).astype(np.uint8)
        bits = np.unpackbits(levels[:, :, None], axis=2, bitorder="little", count=self.bits).reshape(len(x), -1)
        tail = np.stack([length, second, shifted @ centroid], axis=1).astype("<f4")
        return np.concatenate([np.packbits(bits, axis=1, bitorder="little"), tail.view(np.uint8).reshape(len(x), 12)], axis=1)

    def _opened(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        bits = np.unpackbits(codes[:, :-12], axis=1, bitorder="little", count=self.dim * self.bits)
        levels = np.packbits(bits.reshape(len(codes), self.dim, self.bits), axis=2, bitorder="little")[:, :, 0].astype(np.float64)
        tail = np.ascontiguousarray(codes[:, -12:]).view("<f4").astype(np.float64)
        if self.bits == 1:
            return levels * 2 - 1, *tail.T
        return np.where(levels >= 1 << (self.bits - 1), levels - (1 << self.bits), levels), *tail.T

    def _scale(self, length: np.ndarray, second: np.ndarray) -> np.ndarray:
        if self.bits > 1:
            return second
        return np.divide(length, np.sqrt(self.dim) * second, out=np.zeros_like(length), where=second > 0)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        levels, length, second, _ = self._opened(codes)
        scale = length / np.sqrt(self.dim) if self.bits == 1 else second
        return (levels * scale[:, None]) @ self.state["rotation"] + self.state["centroid"]

    def estimate(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        levels, length, second, with_centroid = self._opened(codes)
        q, centroid = self._prepared(queries), self.state["centroid"]
        shifted = q - centroid
        turned = shifted @ self.state["rotation"].T
        # rabitq's cross term is <residual, query's residual>; for products the plain query is turned
        if self.metric == "l2sq":
            cross = (turned @ levels.T) * self._scale(length, second)
            return np.maximum(length**2 + (shifted**2).sum(axis=1)[:, None] - 2 * cross, 0)
        cross = (turned @ levels.T) * self._scale(length, second)
        dot = cross + with_centroid + (q @ centroid)[:, None]
        return -dot if self.metric == "ip" else 1 - dot


class ProductQuantizer(Quantizer):
    """One of ``2**bits`` centroids for each of ``m`` slices; distances by a table for each query."""

    name = "pq"
    metrics = ("l2sq", "ip")

    def __init__(self, dim: int, metric: str, m: int | None = None, bits: int = 8) -> None:
        super().__init__(dim, metric)
        m = m if m is not None else max(1, dim // 4)
        if bits not in (4, 8):
            raise ValueError(f"{self.name} bits must be 4 or 8, not {bits}")
        if not 1 <= m <= 255 or dim % m:
            raise ValueError(f"{self.name} m must lie in 1..255 and divide {dim}, not {m}")
        self.m, self.bits = m, bits

    def _slices(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(x, np.float64).reshape(len(x), self.m, -1).transpose(1, 0, 2)

    def train(self, x: np.ndarray) -> None:
        self.state["books"] = np.stack([self._book(s, i) for i, s in enumerate(self._slices(x))])

    def _book(self, x: np.ndarray, slot: int) -> np.ndarray:
        return kmeans(x, 1 << self.bits, 25, slot + 1)

    def _cost(self, x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return squared(x, book)

    def code_size(self) -> int:
        return -(-self.m * self.bits // 8)

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([self._cost(s, b).argmin(axis=1) for s, b in zip(self._slices(x), self.state["books"], strict=True)], axis=1).astype(np.uint8)
        if self.bits == 8:
            return codes
        if self.m % 2:
            codes = np.concatenate([codes, np.zeros((len(x), 1), np.uint8)], axis=1)
        return codes[:, ::2] | codes[:, 1::2] << 4

    def _opened(self, codes: np.ndarray) -> np.ndarray:
        if self.bits == 8:
            return codes
        return np.stack([codes & 15, codes >> 4], axis=2).reshape(len(codes), -1)[:, : self.m]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[c] for b, c in zip(self.state["books"], self._opened(codes).T, strict=True)], axis=1)

    def estimate(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(queries), len(codes)))
        for s, book, code in zip(self._slices(queries), self.state["books"], self._opened(codes).T, strict=True):
            table = squared(s, book) if self.metric == "l2sq" else -s @ book.T
            out += table[:, code]
        return out


    def estimator(self, query: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        tables = np.concatenate([squared(s, b) if self.metric == "l2sq" else -s @ b.T for s, b in zip(self._slices(query[None, :]), self.state["books"], strict=True)])
        slots = np.arange(self.m)
        return lambda codes: tables[slots, self._opened(codes)].sum(axis=1)


class Anisotropic(ProductQuantizer):
    """Product quantization whose loss weighs errors along the vector ``eta`` times those across it."""

    name = "scann"

    def __init__(self, dim: int, metric: str, m: int | None = None, bits: int = 8, eta: float = 4.0) -> None:
        super().__init__(dim, metric, m, bits)
        if not eta > 0:
            raise ValueError("scann eta must be positive")
        self.eta = float(eta)

    def _cost(self, x: np.ndarray, book: np.ndarray) -> np.ndarray:
        whole = squared(x, book)
        norm = np.maximum((x**2).sum(axis=1), 1e-30)[:, None]
        along = ((x**2).sum(axis=1)[:, None] - x @ book.T) ** 2 / norm
        return whole + (self.eta - 1) * along

    def _book(self, x: np.ndarray, slot: int) -> np.ndarray:
        book = kmeans(x, 1 << self.bits, 1, slot + 1)
        before = None
        for _ in range(25 if len(x) >= len(book) else 0):
            cost = self._cost(x, book)
            label = cost.argmin(axis=1)
            if before is not None and (label != before).mean() < 0.01:
                break
            before = label
            weight = np.maximum(cost[np.arange(len(x)), label], 1e-6)
            total = np.bincount(label, weight, len(book))
            sums = np.zeros_like(book)
            np.add.at(sums, label, x * weight[:, None])
            full = total > 0
            book[full] = sums[full] / total[full, None]
        return book


KINDS = {q.name: q for q in (Flat, RaBitQ, ProductQuantizer, Anisotropic)}


def make(kind: str, dim: int, metric: str, **options: object) -> Quantizer:
    if kind not in KINDS:
        raise ValueError(f"unknown quantizer {kind!r}; expected one of {sorted(KINDS)}")
    try:
        return KINDS[kind](dim, metric, **options)
    except TypeError:
        raise ValueError(f"{kind} quantizer does not take all of {sorted(options)}") from None
