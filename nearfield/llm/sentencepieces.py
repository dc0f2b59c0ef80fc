"""SentencePiece encoding and decoding (operator 3): n-best segmentation.

The pieces and scores are those of a public model file; nothing is trained.  A
text is prepared as the model does it (a space put first, every space written
as U+2581) and the piece lattice over its characters is searched twice: a
forward Viterbi pass gives each position the best score of reaching it, and a
backward A-star search from the end uses these as its heuristic.  As they are
exact, complete segmentations leave the queue best first.

A unigram model's scores are log probabilities and are taken as they are.  A
BPE model's scores are minus the merge rank, which add up to nothing sensible;
there -log(rank + 1) stands for a piece's log probability (Zipf's law).  Scores
are rounded to multiples of 2**-20, so that sums of them are exact in any order.

No piece of the model spans certain pairs of neighbouring characters, such as
one where a word ends; every path passes such a place.  The lattice is cut
there into units.  Each distinct unit of a batch goes through the forward pass
once, all of them side by side in arrays; that also gives the loss of its
cheapest change, the second-best way into a position of its best path.  Only the
n - 1 units of a text whose cheapest change loses least can differ from their
best segmentation in the n best of the text; the A-star search gives the n best
of these units, and one over the choices made in them those of the text.

A character without a piece is written in UTF-8 byte pieces at ``UNKNOWN``
each.  Ties go to the segmentation whose last differing piece is longer, and
between units to the change in the earlier one.

Defined results: a null or empty text has no pieces and one segmentation, of
score 0; decoding gives back the text, save that U+2581 in it becomes a space.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm.common import small_arrow
from nearfield.llm.kernels import GOLDEN, U64, groups, ranges, seeds, small_batches

SPACE = "▁"
UNKNOWN = -25.0
#: Longer units are searched one at a time.
_LONG = 256
_NEVER = -math.inf


class _Table:
    """A fixed map from (node, class) to a node: open addressing, looked up by arrays."""

    def __init__(self, key: np.ndarray, value: np.ndarray) -> None:
        self.bits = max(4, int(len(key) * 4).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(key)
        while len(key):
            _, first = np.unique(slot, return_index=True)
            first = first[self.key[slot[first]] < 0]
            self.key[slot[first]], self.value[slot[first]] = key[first], value[first]
            rest = self.key[slot] != key
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & (len(self.key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(U64) * GOLDEN >> U64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        there = self.key[slot]
        out = np.where(there == key, self.value[slot], np.int32(-1))
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            slot = (slot[todo] if len(slot) != len(todo) else slot) + 1 & (len(self.key) - 1)
            there = self.key[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.value[slot[hit]]
            on = ~hit & (there >= 0)
            todo, slot = todo[on], slot[on]
        return out


@dataclass
class Units:
    """The distinct units of a batch after the forward pass: each one's best score, the
    loss of its cheapest change (inf: it has one segmentation only), and its best ids."""

    best: np.ndarray
    loss: np.ndarray
    count: np.ndarray
    first: np.ndarray
    ids: np.ndarray


class Pieces:
    """A model's pieces, and the searches over them."""

    def __init__(self, path: str, nbest: int = 2) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        raw = [model.get_score(i) for i in range(size)]
        ranked = sum(s == -float(int(-s)) for s in raw) > 0.9 * size  # whole numbers: ranks of a BPE model
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.nbest = nbest
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        spelt = [name.encode() for name in self.names]
        for b, i in enumerate(self.bytes):
            if model.is_byte(i):
                spelt[i] = bytes([b])
        self.spelling = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_size = np.array([len(x) for x in spelt], np.int64)
        self.spelt_at = np.cumsum(self.spelt_size) - self.spelt_size
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i, name in enumerate(self.names):
            if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i):
                continue
            self.ids[name] = i
            self.score[name] = round((-math.log(min(-raw[i], size) + 1) if ranked else raw[i]) * 2**20) / 2**20
        self.longest = max(map(len, self.ids), default=0)
        self._arrays()

    def _arrays(self) -> None:
        """The trie of the pieces, and which characters pieces join, as arrays."""
        letters = sorted({ord(c) for name in self.ids for c in name})
        self.width = len(letters) + 1  # class 0: in no piece
        self.class_of = np.zeros(0x110000, np.uint16)
        self.class_of[letters] = np.arange(1, self.width)
        self.joined = np.zeros(self.width * self.width, bool)
        children: dict[tuple[int, int], int] = {}
        piece: dict[int, tuple[float, int]] = {}
        for name, i in self.ids.items():
            classes = self.class_of[[ord(c) for c in name]].tolist()
            for a, b in zip(classes, classes[1:]):
                self.joined[a * self.width + b] = True
            node = 0
            for c in classes:
                node = children.setdefault((node, c), len(children) + 1)
            piece[node] = (self.score[name], i)
        key = np.array([a * self.width + c for a, c in children] or [0], np.int64)
        value = np.array(list(children.values()) or [-1], np.int32)
        self.child = _Table(key[key >= self.width], value[key >= self.width])
        self.root = np.full(self.width, -1, np.int32)
        self.root[key[key < self.width]] = value[key < self.width]
        self.inner = np.zeros(len(children) + 1, bool)
        self.inner[key // self.width] = True
        self.node_score = np.full(len(children) + 1, _NEVER)
        self.node_id = np.full(len(children) + 1, -1, np.int32)
        for node, (s, i) in piece.items():
            self.node_score[node], self.node_id[node] = s, i
        self.alone = (self.root < 0) | (self.node_score[self.root] == _NEVER)  # no piece of this letter only

    def lattice(self, unit: str) -> tuple[list[list[tuple[int, float]]], list[float]]:
        """For each position the (start, score) of the pieces that end there, and
        its forward Viterbi score: that of the best path from the start."""
        n, score = len(unit), self.score
        into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        best = [_NEVER] * (n + 1)
        best[0] = 0.0
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                s = score.get(unit[start:end])
                if s is not None:
                    into[end].append((start, s))
            if unit[end - 1] not in score:
                into[end].append((end - 1, UNKNOWN * len(unit[end - 1].encode("utf-8", "surrogatepass"))))
            best[end] = max(best[start] + s for start, s in into[end])
        return into, best

    def segmentations(self, unit: str, most: int | None = None) -> Iterator[tuple[float, tuple[int, ...]]]:
        """(score, cuts) of all segmentations, best first: A-star from the end back.

        With ``most`` only so many are wanted: as each entry of the queue stands for
        a segmentation of its own, of exactly its score, one that ``most`` others
        beat is not queued.
        """
        into, best = self.lattice(unit)
        queue: list[tuple] = [(-best[-1], len(unit), 0, 0.0, None)]  # score, place, number, score behind, places behind
        push, pop = heapq.heappush, heapq.heappop
        rivals: list[float] = []  # the most - 1 best scores beside the best one
        least = _NEVER if most is None or most > 1 else best[-1]
        number = 0
        while queue:
            _, at, _, done, behind = pop(queue)
            behind = (at, behind)
            if not at:
                cuts = []
                while behind is not None:
                    at, behind = behind
                    cuts.append(at)
                yield done, tuple(cuts)
                continue
            fresh = []
            for start, s in into[at]:
                score = best[start] + s + done
                if score >= least:
                    number += 1
                    push(queue, (-score, start, number, s + done, behind))
                    fresh.append(score)
            if len(fresh) > 1 and most is not None and most > 1:
                # one of them goes on with the entry's own segmentation, the others are new
                fresh.remove(max(fresh))
                rivals = sorted(rivals + fresh, reverse=True)[: most - 1]
                if len(rivals) == most - 1:
                    least = rivals[-1]

    def _ids_of(self, unit: str, cuts: tuple[int, ...]) -> np.ndarray:
        out = array("i")
        for a, b in zip(cuts, cuts[1:]):
            i = self.ids.get(unit[a:b])
            if i is not None:
                out.append(i)
            else:
                out.extend([self.bytes[x] for x in unit[a:b].encode("utf-8", "surrogatepass")])
        return np.frombuffer(out, "<i4")

    def unit(self, text: str, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best of a unit: (score, ids), best first."""
        return [(s, self._ids_of(text, cuts)) for s, cuts in islice(self.segmentations(text, n), n)]

    def forward(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> Units:
        """The forward Viterbi pass over distinct units, ``codes[start:start + size]`` each."""
        n = len(start)
        order = np.argsort(-size, kind="stable")
        long = int((size > _LONG).sum())
        rank = order[long:]  # units by falling length: those that reach a place come first
        names = [codes[a : a + b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(start[order[:long]].tolist(), size[order[:long]].tolist(), strict=True)]
        start, size = start[rank].astype(np.int32), size[rank]
        deepest = int(size[0]) if len(size) else 0
        longer = np.searchsorted(-size, -np.arange(deepest + 1), "left")  # how many have more letters than t
        classes = self.class_of[codes]
        reach = [len(size), *longer[:-1].tolist()]  # how many have t letters at least
        best = [np.full(m, _NEVER) for m in reach]
        second = [np.full(m, _NEVER) for m in reach]
        length = [np.zeros(m, np.int32) for m in reach]
        piece = [np.zeros(m, np.int32) for m in reach]
        if len(best):
            best[0][:] = 0.0

        def way(to: int, who: np.ndarray, score: np.ndarray, letters: int, ids: np.ndarray) -> None:
            old = best[to][who]
            second[to][who] = np.maximum(second[to][who], np.minimum(old, score))
            up = score > old
            who = who[up]
            best[to][who], length[to][who], piece[to][who] = score[up], letters, ids[up]

        for t in range(deepest):
            m = int(longer[t])
            here, now = best[t], classes[start[:m] + t]
            strange = np.flatnonzero(self.alone[now])
            if len(strange):
                code = codes[start[strange] + t].astype(np.int64)
                many = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
                way(t + 1, strange, here[strange] + UNKNOWN * many, 1, (-1 - code).astype(np.int32))
            node = self.root[now]
            alive = np.flatnonzero(node >= 0)
            node = node[alive]
            k = 0
            while len(alive):
                score = self.node_score[node]
                whole = np.flatnonzero(score > _NEVER)
                who = alive[whole]
                k += 1
                way(t + k, who, here[who] + score[whole], k, self.node_id[node[whole]])
                if t + k >= deepest:
                    break
                last = int(np.searchsorted(alive, longer[t + k]))
                on = np.flatnonzero(self.inner[node[:last]])
                alive, node = alive[on], node[on]
                node = self.child.get(node * np.int64(self.width) + classes[start[alive] + (t + k)])
                on = np.flatnonzero(node >= 0)
                alive, node = alive[on], node[on]

        # back along the best paths: the cheapest change, and the pieces from the last to the first
        base = np.cumsum([0, *map(len, best)])
        flat_best, flat_second, flat_length, flat_piece = map(np.concatenate, (best, second, length, piece))
        loss, count = np.full(n, math.inf), np.zeros(n, np.int64)
        made: list[tuple[np.ndarray, np.ndarray]] = []
        who, at = np.arange(len(size)), size.astype(np.int64)
        top = np.zeros(n)
        top[rank] = flat_best[base[at] + who]
        while len(who):
            place = base[at] + who
            loss[rank[who]] = np.minimum(loss[rank[who]], flat_best[place] - flat_second[place])
            made.append((rank[who], flat_piece[place]))
            count[rank[who]] += 1
            at = at - flat_length[place]
            on = np.flatnonzero(at > 0)
            who, at = who[on], at[on]
        alone: dict[int, np.ndarray] = {}
        for i, name in zip(order[:long].tolist(), names, strict=True):
            found = self.unit(name, 2)
            top[i], alone[i], count[i] = found[0][0], found[0][1], len(found[0][1])
            loss[i] = found[0][0] - found[1][0] if len(found) > 1 else math.inf
        first = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), np.int32)
        place = first + count - 1
        for i, found in made:
            ids[place[i]] = found
            place[i] -= 1
        for i, found in alone.items():
            ids[first[i] : first[i] + count[i]] = found
        strange = np.flatnonzero(ids < 0)
        if len(strange):  # letters without a piece become their bytes
            spelt = [[self.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in (-1 - ids[strange]).tolist()]
            many = np.ones(len(ids), np.int64)
            many[strange] = [len(x) for x in spelt]
            after = np.cumsum(many)
            ids = np.repeat(ids, many)
            for at, x in zip((after - many)[strange].tolist(), spelt, strict=True):
                ids[at : at + len(x)] = x
            after = np.concatenate([[0], after])
            first, count = after[first], after[first + count] - after[first]
        return Units(top, loss, count, first, ids)

    def encode_all(self, texts: list[str], nbest: int | None = None) -> list[list[tuple[float, np.ndarray]]]:
        """For each text its n best segmentations: (score, ids), best first."""
        n = self.nbest if nbest is None else nbest
        prepared = [f" {t}".replace(" ", SPACE) if t else "" for t in texts]
        joint = "".join(prepared)
        if not joint:
            return [[(0.0, np.zeros(0, "<i4"))] for _ in texts]
        codes = np.frombuffer(joint.encode("utf-32-le", "surrogatepass"), np.uint32)
        until = np.cumsum([len(t) for t in prepared])
        classes = self.class_of[codes].astype(np.int32)
        cut = np.ones(len(codes), bool)
        np.logical_not(self.joined[classes[:-1] * self.width + classes[1:]], out=cut[1:])
        cut[until[until < len(codes)]] = True
        start = np.flatnonzero(cut)
        size = np.diff(start, append=len(codes))
        first, which = self._distinct(codes, start, size)
        units = self.forward(codes, start[first], size[first])

        count = units.count[which]
        ids = units.ids[ranges(units.first[which], count)]
        token = np.concatenate([[0], np.cumsum(count)])
        unit = np.searchsorted(start, np.concatenate([[0], until]))
        score = np.concatenate([[0.0], np.cumsum(units.best[which])])
        score = score[unit[1:]] - score[unit[:-1]]  # exact, as all sums are
        loss = units.loss[which]
        known: dict[int, list] = {}
        out = []
        for i, (a, b) in enumerate(zip(unit[:-1].tolist(), unit[1:].tolist(), strict=True)):
            found = [(float(score[i]), ids[token[a] : token[b]])]
            if n > 1 and b > a:
                near = a + np.argmin(loss[a:b], keepdims=True) if n == 2 else a + np.argsort(loss[a:b], kind="stable")[: n - 1]
                near = sorted(near[loss[near] < math.inf].tolist())
                for j in near:
                    if (u := int(which[j])) not in known:
                        known[u] = self.unit(joint[start[j] : start[j] + size[j]], n)
                found += self._others(found[0], [(token[j] - token[a], token[j + 1] - token[a], known[int(which[j])]) for j in near], n)
            out.append(found)
        return out

    @staticmethod
    def _distinct(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place of each distinct unit, and which one each unit is."""
        factor = seeds(int(size.max()) + 1, 7)
        terms = factor[ranges(np.zeros_like(start), size)]
        terms *= codes
        hashed = np.add.reduceat(terms, start) + size.astype(U64) * factor[-1]
        first, which = groups(hashed)
        same = size[first][which] == size
        if not same.all() or not (codes[ranges(start[first][which], size)] == codes).all():
            return np.arange(len(start)), np.arange(len(start))  # a clash of hashes: every unit by itself
        return first, which

    def encode(self, text: str, nbest: int | None = None) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a whole text: (score, ids), best first."""
        return self.encode_all([text], nbest)[0]

    @staticmethod
    def _others(best: tuple[float, np.ndarray], changing: list[tuple[int, int, list]], n: int) -> list[tuple[float, np.ndarray]]:
        """The second to n-th best of a text: ``changing`` are (first id, end, n best) of its
        units that may differ, searched best first over which one each of them takes."""
        queue: list[tuple[float, tuple[int, ...]]] = [(0.0, (0,) * len(changing))]
        seen, out = {queue[0][1]}, []
        while queue and len(out) < n:
            loss, choice = heapq.heappop(queue)
            out.append((loss, choice))
            for j, (_, _, ways) in enumerate(changing):
                k = choice[j] + 1
                following = (*choice[:j], k, *choice[j + 1 :])
                if k < len(ways) and following not in seen:
                    seen.add(following)
                    heapq.heappush(queue, (loss + ways[k - 1][0] - ways[k][0], following))
        result = []
        for loss, choice in out[1:]:
            parts, last = [], 0
            for k, (a, b, ways) in zip(choice, changing, strict=True):
                if k:
                    parts += [best[1][last:a], ways[k][1]]
                    last = b
            result.append((best[0] - loss, np.concatenate([*parts, best[1][last:]])))
        return result

    def decode_all(self, segmentations: list[np.ndarray]) -> list[str]:
        """The texts of segmentations; bytes that are no UTF-8 become U+FFFD."""
        ids = np.concatenate([np.zeros(0, np.int64), *segmentations])
        joint = self.spelling[ranges(self.spelt_at[ids], self.spelt_size[ids])].tobytes()
        until = np.concatenate([[0], np.cumsum(self.spelt_size[ids])])[np.cumsum([0, *map(len, segmentations)])].tolist()
        out = []
        for a, b in zip(until, until[1:]):
            try:
                text = joint[a:b].decode("utf-8", "surrogatepass")
            except UnicodeDecodeError:
                text = joint[a:b].decode("utf-8", "replace")
            text = text.replace(SPACE, " ")
            out.append(text[1:] if text[:1] == " " else text)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation."""
        return self.decode_all([ids])[0]


_models: dict[tuple[str, int], Pieces] = {}


def pieces(path: str, nbest: int) -> Pieces:
    """This process's model."""
    if (path, nbest) not in _models:
        _models[path, nbest] = Pieces(path, nbest)
    return _models[path, nbest]


ENCODED = "ids array<int>, score double, second_score double, nbest array<struct<ids: array<int>, score: double>>"


def _id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, "<i4"), pa.int32()))


def encode(docs: DataFrame, path: str, nbest: int = 2, key: str = "doc_id", text: str = "text", decoded: str | None = None) -> DataFrame:
    """doc_id, text, ids, score of the best and score of the second-best segmentation
    (null if there is none), and nbest: (ids, score) of the ``nbest`` best ones, or of
    all there are, best first.  ``decoded`` names one more column for the text that the
    ids give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, nbest)
        for batch in small_batches(batches, text):
            made = model.encode_all([t or "" for t in batch.column(text).to_pylist()])
            listed = pa.StructArray.from_arrays([_id_lists([x for m in made for _, x in m]), pa.array([s for m in made for s, _ in m], pa.float64())], ["ids", "score"])
            best = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)), listed)
            second = pa.array([m[1][0] if len(m) > 1 else None for m in made], pa.float64())
            arrays = [batch.column(key), batch.column(text), _id_lists([m[0][1] for m in made]), pa.array([m[0][0] for m in made], pa.float64()), second, best]
            if decoded:
                arrays.append(pa.array(model.decode_all([m[0][1] for m in made]), pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [key, text, "ids", "score", "second_score", "nbest", *([decoded] if decoded else [])])

    rows = docs.select(key, docs[text].cast("string").alias(text))
    kinds = ", ".join(f"`{x}` {t}" for x, t in rows.dtypes)
    return small_arrow(rows).mapInArrow(run, f"{kinds}, {ENCODED}" + (f", `{decoded}` string" if decoded else ""))


def decode(encoded: DataFrame, path: str, out: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids spell."""
    fields = [x for x in encoded.columns if x != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, 2)
        for batch in batches:
            ids = batch.column("ids")
            made = model.decode_all([x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64) for x in ids])
            texts = [t if ok else None for t, ok in zip(made, ids.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in fields), pa.array(texts, pa.string())], [*fields, out])

    return small_arrow(encoded).mapInArrow(run, encoded.drop(out).schema.add(out, "string"))


def encode_report(docs: DataFrame, path: str, nbest: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian uint32), score,
    second_score, round_trip: whether decoding the ids gives the text back, and
    nbest: (n_tokens, ids_crc32, score) of each of the n best, best first."""
    import zlib

    kind = pa.list_(pa.struct([("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, nbest)
        for batch in small_batches(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            made = model.encode_all(texts)
            same = [x == t.replace(SPACE, " ") for t, x in zip(texts, model.decode_all([m[0][1] for m in made]), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(m[0][1]) for m in made], pa.int64()), pa.array([zlib.crc32(m[0][1].tobytes()) for m in made], pa.int64()),
                    pa.array([m[0][0] for m in made], pa.float64()), pa.array([m[1][0] if len(m) > 1 else None for m in made], pa.float64()), pa.array(same),
                    pa.array([[{"n_tokens": len(x), "ids_crc32": zlib.crc32(x.tobytes()), "score": s} for s, x in m] for m in made], kind),
                ],
                ["doc_id", "n_tokens", "ids_crc32", "score", "second_score", "round_trip", "nbest"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return small_arrow(rows).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, score double, second_score double, round_trip boolean, nbest array<struct<n_tokens: long, ids_crc32: long, score: double>>")
