"""Deep-shallow suffix sorting of byte strings.

Multikey quicksort to a shallow depth: all groups of equal prefixes are split
at once, three ways around a pivot of eight bytes each; a group whose bytes
equal its pivot goes eight bytes deeper.  What is still equal at the shallow
depth has long common prefixes; there a blind trie (a Patricia tree that holds
only branching places and one byte for each branch) is built for the group.
Inserting a string goes down by single bytes, compares once with the leaf it
ends at, and branches where the two differ.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 48


class _Node:
    __slots__ = ("branches", "depth", "rows")

    def __init__(self, depth: int, rows: list[int] | None) -> None:
        self.depth = depth  # bytes that everything below has in common
        self.rows = rows  # of a leaf: equal strings
        self.branches: dict[int, _Node] = {}  # by the byte at depth; -1: the string ends


def _common(a: bytes, b: bytes, start: int) -> int:
    """How many bytes two strings share, if they share ``start``."""
    n = min(len(a), len(b))
    step = 64
    while start < n:
        x, y = a[start : min(start + step, n)], b[start : min(start + step, n)]
        if x != y:
            return start + len(x) - (((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) >> 3)
        start += step
    return n


def blind_trie(strings: list[bytes], start: int) -> tuple[list[int], list[int]]:
    """Sorted places of strings that share ``start`` bytes, and how many bytes
    each shares with the one before it (the first: ``start``)."""
    root = _Node(len(strings[0]), [0])
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while node.rows is None:  # down by single bytes, without comparing what lies between
            key = s[node.depth] if node.depth < len(s) else -1
            node = node.branches.get(key) or next(iter(node.branches.values()))
        other = strings[node.rows[0]]
        shared = _common(s, other, start)
        if shared == len(s) == len(other):
            node.rows.append(i)
            continue
        above, key, node = None, 0, root
        while node.depth < shared or (node.rows is None and node.depth == shared):
            above, key = node, s[node.depth] if node.depth < len(s) else -1
            if node.depth == shared or key not in node.branches:
                break
            node = node.branches[key]
        leaf = _Node(len(s), [i])
        if above is not None and above.depth == shared:
            above.branches[key] = leaf
            continue
        fork = _Node(shared, None)
        fork.branches[other[shared] if shared < len(other) else -1] = node
        fork.branches[s[shared] if shared < len(s) else -1] = leaf
        if above is None:
            root = fork
        else:
            above.branches[key] = fork
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple[_Node, int]] = [(root, start)]
    while stack:
        node, before = stack.pop()
        if node.rows is not None:
            order += node.rows
            lcp += [before, *[len(strings[node.rows[0]])] * (len(node.rows) - 1)]
            continue
        keys = sorted(node.branches)
        stack += [(node.branches[k], node.depth) for k in keys[:0:-1]]
        stack.append((node.branches[keys[0]], before))
    return order, lcp


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of the strings, and how many bytes each shares with the one before (the first: 0).

    A string that is a prefix of another comes before it.
    """
    n = len(strings)
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    if n < 2:
        return order, lcp
    length = np.fromiter(map(len, strings), np.int64, n)
    width = -(-shallow // 8)
    heads = np.frombuffer(b"".join([s[: 8 * width].ljust(8 * width, b"\0") for s in strings]), ">u8").reshape(n, width).astype(np.uint64)
    heads = np.concatenate([heads, np.minimum(length, 8 * width).astype(np.uint64)[:, None]], axis=1)  # padding isn't content
    begin = np.array([0])
    end = np.array([n])
    depth = np.array([0])
    deep: list[tuple[int, int]] = []
    while len(begin):
        size = end - begin
        group = np.repeat(np.arange(len(begin)), size)
        at = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        row = order[at]
        key = heads[row, depth[group]]
        pivot = heads[order[begin + size // 2], depth]
        side = (key > pivot[group]).astype(np.int8) - (key < pivot[group]).astype(np.int8)
        move = np.lexsort((side, group))
        order[at] = row[move]
        below = np.bincount(group, side < 0, len(begin)).astype(np.int64)
        above = np.bincount(group, side > 0, len(begin)).astype(np.int64)
        first, last = begin + below, end - above
        equal = depth + 1
        done = equal > width
        deep += list(zip(first[done].tolist(), last[done].tolist(), strict=True))
        parts = [(begin, first, depth), (first[~done], last[~done], equal[~done]), (last, end, depth)]
        begin, end, depth = (np.concatenate(x) for x in zip(*parts, strict=True))
        more = end - begin > 1
        begin, end, depth = begin[more], end[more], depth[more]
    for a, b in deep:
        if b - a > 1 and length[order[a]] > 0:
            rows = order[a:b].tolist()
            inner, shared = blind_trie([strings[i] for i in rows], min(8 * width, int(length[rows[0]])))
            order[a:b] = [rows[i] for i in inner]
            lcp[a + 1 : b] = shared[1:]
        elif b - a > 1:
            lcp[a + 1 : b] = 0
    inside = np.zeros(n, bool)
    for a, b in deep:
        inside[a + 1 : b] = True
    rest = np.flatnonzero(~inside[1:]) + 1
    a, b = heads[order[rest - 1], :width], heads[order[rest], :width]
    differ = a != b
    word = np.where(differ.any(axis=1), differ.argmax(axis=1), width - 1)
    x = a[np.arange(len(rest)), word] ^ b[np.arange(len(rest)), word]
    bits = np.zeros(len(rest), np.int64)
    some = x != 0
    top = np.zeros(len(rest), np.int64)
    y = x.copy()
    for shift in (32, 16, 8):
        big = y >> np.uint64(shift) != 0
        top += np.where(big, shift // 8, 0)
        y = np.where(big, y >> np.uint64(shift), y)
    bits[some] = 7 - top[some]
    bits[~some] = 8
    both = np.minimum(length[order[rest - 1]], length[order[rest]])
    lcp[rest] = np.minimum(word * 8 + bits, both)
    return order, lcp
