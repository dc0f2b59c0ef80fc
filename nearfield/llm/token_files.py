"""Token-ID output (operator 8): one compressed wavelet matrix per shard.

File format of a shard (one binary value): a zstandard frame around

    magic ``NFWM``, version, levels (bytes), end id (uint32),
    number of ids and of documents (uint64, little-endian),
    for each level, highest bit first: its number of zeros (uint64), its
    bit-plane (packed, low bit first) and the ones before each 512 bits (uint32).

At each level the ids whose bit is 0 go, in order, before those whose bit is 1;
rank over the planes then gives the id at a position (``access``), the
occurrences of an id before a position (``count``) and, with select, the place
of its j-th occurrence (``locate``).  After the planes come the documents'
lengths (uint32, with the end id) and their ids (int64).

Defined results: a null text is empty and gives only the end id; documents are
in ascending doc_id, null ids first, rows of one id by a hash of their text; an
empty table gives no shard.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import small_arrow
from nearfield.llm.kernels import Texts, Words, groups, ranges, small_batches, texts_of, word_hashes

END_ID = 2
MAGIC = b"NFWM"
_HEAD = struct.Struct("<4sBBHIQQ")
_WORD = 512
SHARD_TOKENS = 1 << 20
#: Pieces that a process remembers (about 150 bytes each).
_GENERATION = 1_000_000
#: Pieces of one call of the library.
_CALL = 20_000


class WaveletMatrix:
    """Planes over a sequence of ids."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]) -> None:
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        zeros, planes, ranks = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (ids >> ids.dtype.type(level)) & ids.dtype.type(1) != 0
            plane = np.packbits(bit, bitorder="little")
            ones = ids.compress(bit)
            ids = np.concatenate([ids.compress(~bit), ones])
            zeros.append(len(ids) - len(ones))
            planes.append(plane)
            ranks.append(cls._samples(plane))
        return cls(len(ids), zeros, planes, ranks)

    @staticmethod
    def _samples(plane: np.ndarray) -> np.ndarray:
        step = _WORD // 8
        padded = np.zeros(-(-len(plane) // step) * step, np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded.reshape(-1, step)).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        block, rest = divmod(i, _WORD)
        part = np.unpackbits(self.planes[level][block * _WORD // 8 : -(-i // 8)], bitorder="little", count=rest) if rest else ()
        return int(self.ranks[level][block]) + int(np.sum(part, dtype=np.int64))

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level in range(len(self.planes)):
            bit = self.planes[level][i >> 3] >> (i & 7) & 1
            one = self._rank1(level, i)
            i = self.zeros[level] + one if bit else i - one
            value = value << 1 | int(bit)
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        begin = 0
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, begin), self._rank1(level, end)
            if token >> (len(self.planes) - 1 - level) & 1:
                begin, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def count(self, token: int, end: int | None = None) -> int:
        """How often the id stands before ``end``."""
        begin, end = self._range(token, self.n if end is None else end)
        return end - begin

    def _select(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) such bit of a plane."""
        samples = self.ranks[level].astype(np.int64)
        if not bit:
            samples = np.minimum(np.arange(len(samples), dtype=np.int64) * _WORD, self.n) - samples
        block = int(np.searchsorted(samples, k, "right")) - 1
        lo = block * _WORD
        bits = np.unpackbits(self.planes[level][lo // 8 : (lo + _WORD) // 8], bitorder="little")[: self.n - lo]
        return lo + int(np.flatnonzero(bits == bit)[k - int(samples[block])])

    def locate(self, token: int, j: int) -> int:
        """The position of the id's j-th occurrence, from 0."""
        begin, end = self._range(token, self.n)
        if not 0 <= j < end - begin:
            raise IndexError(f"id {token} has {end - begin} occurrences")
        i = begin + j
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for place, level in enumerate(range(len(self.planes) - 1, -1, -1)):
            bit = np.unpackbits(self.planes[level], bitorder="little", count=self.n).view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~bit)] = ids[: self.zeros[level]]
            above[np.flatnonzero(bit)] = ids[self.zeros[level] :] | kind(1 << place)
            ids = above
        return ids


def write_shard(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray) -> bytes:
    m = WaveletMatrix.build(ids)
    parts = [_HEAD.pack(MAGIC, 1, len(m.planes), 0, END_ID, m.n, len(lengths))]
    for zeros, plane, rank in zip(m.zeros, m.planes, m.ranks, strict=True):
        parts += [struct.pack("<Q", zeros), plane.tobytes(), rank.astype("<u4").tobytes()]
    parts += [lengths.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def read_shard(blob: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """The matrix, the documents' lengths (with the end id) and their ids."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    magic, version, levels, _, _, n, docs = _HEAD.unpack_from(raw)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token shard")
    at, width, blocks = _HEAD.size, -(-n // 8), -(-(-(-n // 8)) // (_WORD // 8)) + 1
    zeros, planes, ranks = [], [], []
    for _ in range(levels):
        zeros.append(struct.unpack_from("<Q", raw, at)[0])
        planes.append(np.frombuffer(raw, np.uint8, width, at + 8))
        ranks.append(np.frombuffer(raw, "<u4", blocks, at + 8 + width))
        at += 8 + width + 4 * blocks
    lengths = np.frombuffer(raw, "<u4", docs, at).astype(np.int64)
    return WaveletMatrix(n, zeros, planes, ranks), lengths, np.frombuffer(raw, "<i8", docs, at + 4 * docs)


#: Classes of bytes: white space, ASCII letters, digits, marks, and others, which are kept with what is beside them.
_BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CLASS[[ord("'"), ord("|")]] = _OTHER  # the one may begin a suffix, the other stands in added tokens
#: Whether the pre-tokenizer cuts between two bytes of these classes, whatever is around them.
_CUT = np.zeros((5, 5), bool)
_CUT[_BLANK] = _CUT[:, _BLANK] = True
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _MARK), (_DIGIT, _MARK), (_DIGIT, _DIGIT)):
    _CUT[_a, _b] = _CUT[_b, _a] = True

#: The normaliser and the pre-tokenizer for which the cuts hold (fixed values).
_NORMALISERS = ["NFC", "Replace", "Lowercase"]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _cuts_hold(description: dict) -> bool:
    before, first = description.get("normalizer") or {}, ((description.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    names = [x["type"] for x in before.get("normalizers", [])]
    added = [x for x in description.get("added_tokens", []) if x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or not re.fullmatch(r"<\|[a-z]+\|>", x["content"])]
    return names == _NORMALISERS and first.get("pattern") == {"Regex": _WORDS} and first.get("behavior") == "Removed" and first.get("invert") is True and not added


class Encoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    Where the tokenizer file has the normaliser and the pre-tokenizer written
    above, texts are cut where these cut in any case: at ASCII white space, and
    between ASCII letters, digits and marks (but not beside an apostrophe or a
    bar, which may begin a suffix or belong to an added token; nor beside other
    characters).  Pieces of ASCII letters only are lower-cased.  Every distinct
    piece goes through the whole library once, many in one call; a memory of
    ``_GENERATION`` pieces is shared by batches.  With any other file each text
    goes through the library as it is.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cut = _cuts_hold(json.loads(self.library.to_str()))
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        """Put new pieces into the memory."""
        words = [x.decode() for x in pieces]
        found, counts = [self.ids], []
        for i in range(0, len(words), _CALL):
            part = words[i : i + _CALL]
            start = np.cumsum([0, *(len(w) + 1 for w in part)])[:-1]
            made = self.library.encode(" ".join(part), add_special_tokens=False)
            at = np.array([a for a, _ in made.offsets], np.int64)
            counts.append(np.bincount(np.searchsorted(start, at, "right") - 1, minlength=len(part)))
            found.append(np.array(made.ids, np.uint32))
        count = np.concatenate(counts)
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate(found)

    def encode_all(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        if not self.cut:
            made = [self.library.encode(texts.of(i).decode(), add_special_tokens=False).ids for i in range(len(texts))]
            return np.array([x for ids in made for x in ids], np.uint32), np.array([len(x) for x in made], np.int64)
        pieces, low = _pieces(texts)
        if not len(pieces.start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        one, which = groups(word_hashes(low, pieces))
        start, end = pieces.start[one], pieces.end[one]
        size = pieces.end - pieces.start
        if not ((end - start)[which] == size).all() or not (low[ranges(start[which], size)] == low[ranges(pieces.start, size)]).all():
            start, end, which = pieces.start, pieces.end, np.arange(len(size))  # a clash of hashes: every piece by itself
        raw = low.tobytes()
        keys = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        if len(self.known) > _GENERATION:
            self.forget()
        fresh = [x for x in dict.fromkeys(keys) if x not in self.known]
        if fresh:
            self._learn(fresh)
        row = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[which]
        count = self.count[row]
        until = np.concatenate([[0], np.cumsum(count)])
        return self.ids[ranges(self.first[row], count)], until[pieces.last] - until[pieces.first]

    def __call__(self, text: str) -> np.ndarray:
        return self.encode_all(texts_of(pa.array([text], pa.string())))[0]


def _pieces(texts: Texts) -> tuple[Words, np.ndarray]:
    """The pieces that texts are cut into, and the texts' bytes with pieces of letters lower-cased."""
    buf = texts.buf
    kind = _CLASS[buf]
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = kind != _BLANK
    full = texts.end > texts.start
    if int((texts.end - texts.start).sum()) != len(buf):  # bytes of null entries lie between
        covered = np.zeros(len(buf), bool)
        covered[ranges(texts.start, texts.end - texts.start)] = True
        inside[:-1] &= covered
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = _CUT.ravel()[kind[:-1] * np.uint8(5) + kind[1:]]
    edge[texts.start[full]] = edge[texts.end[full]] = True
    start = np.flatnonzero(inside & edge)
    end = np.flatnonzero(inside[:-1] & edge[1:]) + 1
    low = buf.copy()
    capital = np.flatnonzero((buf >= 65) & (buf <= 90))
    if len(start) and len(capital):
        other = np.concatenate([[0], np.cumsum(kind != _LETTER, dtype=np.int32)])
        plain = other[end] == other[start]
        piece = np.maximum(np.searchsorted(start, capital, "right") - 1, 0)
        low[capital[plain[piece]]] += 32
    first = np.searchsorted(start, texts.start)
    return Words(start, end, first, np.maximum(first, np.searchsorted(start, texts.end))), low


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_NO_ID = -(1 << 63)
SHARDS = "first_doc long, part int, place int, n_ids long, blob binary"


def write_token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each shard, in ascending doc_id by (part, place).

    Texts are range partitioned by doc_id, which is the only shuffle; write the
    result with ``stage`` or to any path, where each row group holds one shard.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(parts, "key", "hash").sortWithinPartitions("key", "hash", "text").select("key", "text")

    def shard(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], place: int) -> pa.RecordBatch:
        from pyspark import TaskContext

        keys, lengths, ids = map(np.concatenate, zip(*held, strict=True))
        if ids.max() < 1 << 16:
            ids = ids.astype(np.uint16)
        part = TaskContext.get().partitionId()
        values = [(int(keys[0]), pa.int64()), (part, pa.int32()), (place, pa.int32()), (len(ids), pa.int64()), (write_shard(ids, lengths, keys), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], [x.split()[0] for x in SHARDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_all
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = place = 0
        for batch in small_batches(batches, "text"):
            ids, lengths = encode(texts_of(batch.column("text")))
            until = np.cumsum(lengths)
            ids, until, lengths = np.insert(ids, until, END_ID), np.concatenate([[0], until + np.arange(1, len(until) + 1)]), lengths + 1
            keys = batch.column("key").to_numpy()
            first = 0
            while first < len(keys):  # as many documents as the shard has room for
                last = max(first + (not held), int(np.searchsorted(until, until[first] + SHARD_TOKENS - size, "right")) - 1)
                if last > first:
                    held.append((keys[first:last], lengths[first:last], ids[until[first] : until[last]]))
                    size += int(until[last] - until[first])
                if last < len(keys):
                    yield shard(held, place)
                    held, size, place = [], 0, place + 1
                first = last
        if held:
            yield shard(held, place)

    return small_arrow(rows).mapInArrow(run, SHARDS)


def read_token_files(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    Starts follow from the shards' sizes: the driver adds up one number for
    each shard, and no row is moved.
    """
    sizes = shards.select("part", "place", "n_ids").orderBy("part", "place").collect()
    begin = np.concatenate([[0], np.cumsum([r.n_ids for r in sizes])])
    offsets = {(r.part, r.place): int(b) for r, b in zip(sizes, begin, strict=False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, place, blob in zip(*(batch.column(x) for x in ("part", "place", "blob")), strict=True):
                matrix, lengths, keys = read_shard(blob.as_py())
                data = memoryview(matrix.decode().astype("<u4")).cast("B")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=keys == _NO_ID), pa.array(starts + offsets[part.as_py(), place.as_py()], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return small_arrow(shards.select("part", "place", "blob")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
