"""Plain versions of the operators, for comparison."""

import hashlib
from collections import defaultdict


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def space_words(text):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", ascii_lower(text or "")) if w]


def shingles(text, k):
    w = space_words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def near_components(rows, k, percent):
    """doc_id -> (set size, component) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_set = defaultdict(list)
    for i, s in sets.items():
        if s:
            by_set[s].append(i)
    for ids in by_set.values():
        for i in ids[1:]:
            parent[max(root(i), root(ids[0]))] = min(root(i), root(ids[0]))
    having = defaultdict(list)
    for s, ids in by_set.items():
        for x in s:
            having[x].append(ids[0])
    for i in [ids[0] for ids in by_set.values()]:
        shared = defaultdict(int)
        for x in sets[i]:
            for j in having[x]:
                if j > i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def repeats(rows, length):
    """[(n_bytes, n_removed, n_spans, kept)] by looking every window up."""
    texts = [(t or "").encode() for t in rows]
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
