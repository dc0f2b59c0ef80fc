"""Vectorised text kernels over the UTF-8 bytes of an Arrow batch.

All of them look at whole texts.  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Multipliers of the splitmix64 generator.
MIX_1, MIX_2, GOLDEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words made of ASCII digits, ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True

#: Bytes of words that ASCII white space separates.
NON_SPACE = np.ones(256, bool)
NON_SPACE[0x20] = NON_SPACE[0x09:0x0E] = False

_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=U64)
_LONG_WORD = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x *= MIX_1
    x ^= x >> U64(27)
    x *= MIX_2
    x ^= x >> U64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed)) * GOLDEN) | U64(1)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``first`` to ``first + size - 1`` of each range, one range after the other."""
    until = np.cumsum(size)
    kind = np.int32 if len(size) == 0 or max(int(until[-1]), int(first.max())) < 2**30 else np.int64
    return np.arange(until[-1] if len(until) else 0, dtype=kind) + np.repeat((first - until + size).astype(kind), size)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and for each key which of them it is."""
    order = np.argsort(keys)
    held = keys[order]
    fresh = np.ones(len(keys), bool)
    np.not_equal(held[1:], held[:-1], out=fresh[1:])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return order[fresh], which


@dataclass
class Texts:
    """Lower-cased or raw bytes of consecutive texts; text i is ``buf[start[i]:end[i]]``."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def of(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def texts_of(column: pa.Array) -> Texts:
    """The bytes of a string or binary column, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if pa.types.is_null(column.type) or n == 0:
        none = np.zeros(n, np.int64)
        return Texts(np.zeros(0, np.uint8), none, none)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    lo, hi = int(at[0]), int(at[-1])
    buf = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    start, end = at[:-1] - lo, at[1:] - lo
    if column.null_count:
        end = np.where(np.asarray(column.is_null()), start, end)
    return Texts(buf, start, end)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches of at most ``limit`` text bytes or one row."""
    for batch in batches:
        texts = texts_of(batch.column(column))
        size, first = np.cumsum(texts.end - texts.start), 0
        while first < len(texts):
            before = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


@dataclass
class Words:
    """Words of a batch in text order; those of text i are ``first[i]:last[i]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray


def words_of(texts: Texts, is_word: np.ndarray) -> Words:
    """The maximal runs of word bytes; none crosses from one text to the next."""
    n = len(texts.buf)
    full = np.flatnonzero(texts.end > texts.start)
    if not n or not len(full):
        none = np.zeros(0, np.int64)
        zero = np.zeros(len(texts), np.int64)
        return Words(none, none, zero, zero)
    inside = is_word[texts.buf]
    if int((texts.end - texts.start).sum()) != n:  # bytes of null entries lie between
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, texts.start[full], 1)
        np.add.at(edge, texts.end[full], -1)
        inside &= np.cumsum(edge[:-1]) > 0
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[texts.start[full]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[texts.end[full] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, texts.start)
    return Words(start, end, first, np.maximum(first, np.searchsorted(start, texts.end)))


def word_hashes(buf: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    start, length = words.start, words.end - words.start
    if not len(start):
        return np.zeros(0, U64)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    h = mix64(length.astype(U64) * GOLDEN ^ (eight[start] & _LOW_BYTES[np.minimum(length, 8)]))
    at, todo = 8, np.flatnonzero((length > 8) & (length <= _LONG_WORD))
    while len(todo):
        rest = np.minimum(length[todo] - at, 8)
        h[todo] = mix64(h[todo] * MIX_1 ^ (eight[start[todo] + at] & _LOW_BYTES[rest]))
        at += 8
        todo = todo[length[todo] > at]
    for i in np.flatnonzero(length > _LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(buf[start[i] : words.end[i]].tobytes())
    return h


def lower(texts: Texts) -> Texts:
    """A-Z become a-z; other letters stay."""
    return Texts(LOWER[texts.buf], texts.start, texts.end)


def shingle_sets(texts: Texts, k: int, is_word: np.ndarray = NON_SPACE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    A text with fewer words, but not none, has its whole sequence as one.
    """
    low = lower(texts)
    words = words_of(low, is_word)
    h = word_hashes(low.buf, words)
    place = seeds(k, 11)
    n = max(0, len(h) - k + 1)
    whole = np.zeros(n, U64)
    for j in range(k):
        whole += h[j : n + j] * place[j]
    whole = mix64(whole)
    for a, b in zip(words.first.tolist(), words.last.tolist(), strict=True):
        if b - a >= k:
            s = np.sort(whole[a : b - k + 1])
            fresh = np.empty(len(s), bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            yield s[fresh]
        elif b > a:
            yield mix64((h[a:b] * place[: b - a]).sum(keepdims=True, dtype=U64) + np.array([b - a], U64) * GOLDEN)
        else:
            yield h[:0]
