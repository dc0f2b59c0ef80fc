"""Document fingerprints (operator 1): packed one-permutation MinHash.

A document's set is the distinct hashes of its shingles of five words (words:
runs of non-white-space, A-Z lower-cased; a text with fewer words is one
shingle).  Every shingle hash is binned once, empty bins are filled by optimal
densification, and of each bin only the low ``BITS`` bits are kept, packed and
written in base64.  Two unequal bins agree by chance in one of ``2**BITS``
cases; ``likeness`` takes that bias out again.

Defined results: a null text is an empty one; a document without words has the
fingerprint ``''``, which is like ``''`` (1.0) and unlike anything else (0.0).
Equal texts have equal fingerprints.  Repeated rows are each fingerprinted.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import small_arrow
from nearfield.llm.kernels import GOLDEN, U64, Texts, mix64, shingle_sets, small_batches, texts_of
from nearfield.llm.minhash import signature

WORDS, BINS, BITS = 5, 512, 4


def _pack(sig: np.ndarray) -> str:
    # each bin draws its bits anew, so that few borrowed values don't all agree by one chance
    low = (mix64(sig ^ np.arange(1, BINS + 1, dtype=U64) * GOLDEN) & U64((1 << BITS) - 1)).astype(np.uint8)
    bits = np.unpackbits(low[:, None], axis=1, bitorder="little", count=BITS)
    return base64.b64encode(np.packbits(bits.ravel(), bitorder="little")).decode()


def _unpack(fingerprint: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(base64.b64decode(fingerprint), np.uint8), bitorder="little")
    return np.packbits(bits.reshape(-1, BITS), axis=1, bitorder="little").ravel()


def fingerprints_of(texts: Texts) -> list[str]:
    """The fingerprint of every text of a batch."""
    return [_pack(signature(s, BINS)) if len(s) else "" for s in shingle_sets(texts, WORDS)]


def likeness(a: str, b: str) -> float:
    """The estimated Jaccard similarity of the two documents' sets, 0 to 1.

    With r the share of equal bins, r = J + (1 - J) / 2**BITS on average.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    equal, chance = float((_unpack(a) == _unpack(b)).mean()), 1 / (1 << BITS)
    return min(1.0, max(0.0, (equal - chance) / (1 - chance)))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the column ``out`` added; one narrow pass, no shuffle."""
    schema = docs.drop(out).schema
    fields = [x for x in docs.columns if x != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            made = fingerprints_of(texts_of(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in fields), pa.array(made, pa.string())], [*fields, out])

    return small_arrow(docs).mapInArrow(run, schema.add(out, "string"))


_NO_ID = -(1 << 63)


def _with_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, key, bucket, ghost: rows dealt to buckets of consecutive keys.

    A row's key is its id and a hash of its text, as bytes in ascending order, so
    a repeated id is no bucket's burden; each bucket is a partition.

    A bucket also gets, as ghosts, the first rows of the bucket after it (after
    the last one comes the first), so the successor of each of its rows in
    descending order is in the bucket.  The bounds come from a sort of the keys
    alone; the driver gets one for each partition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("hash"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tops = keyed.select("id", "hash").repartitionByRange(parts, F.col("id").desc(), F.col("hash").desc()).groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("id", "hash")).alias("top"))
    tops = tops.select("top.id", "top.hash").collect()
    bounds = np.unique(_keys(np.array([r.id for r in tops], np.int64), np.array([r.hash for r in tops], np.int64)))  # the largest key of each bucket
    count = len(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _keys(batch.column("id").to_numpy(), batch.column("hash").to_numpy())
            rank = np.searchsorted(bounds, key)  # its bucket is the one of the next larger top
            bucket = count - 1 - rank
            first = np.flatnonzero(bounds[rank] == key)
            take = np.concatenate([np.arange(len(key)), first])
            dealt = np.concatenate([bucket, (bucket[first] - 1) % count])
            ghost = np.arange(len(take)) >= len(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(take)), batch.column("text").take(pa.array(take)), pa.array([x.tobytes() for x in key.view(np.uint8).reshape(-1, 16)[take]], pa.binary()), pa.array(dealt.astype(np.int32)), pa.array(ghost)],
                ["doc_id", "text", "key", "bucket", "ghost"],
            )

    if not count:
        return rows.select("doc_id", "text", F.lit(b"").alias("key"), F.lit(0).alias("bucket"), F.lit(False).alias("ghost"))
    dealt = small_arrow(keyed).mapInArrow(deal, "doc_id long, text string, key binary, bucket int, ghost boolean")
    return dealt.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "ghost", F.col("key").desc(), F.col("text"))


def _keys(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """16 bytes of each row that sort as (id, hash) does."""
    sign = np.uint64(1 << 63)
    both = np.stack([ids.astype(np.int64).view(np.uint64) ^ sign, hashes.astype(np.int64).view(np.uint64) ^ sign], axis=1)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def edit_report(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, beside that of its edited text.

    The edited text is the text whose last floor(n/3) code points are replaced
    by the first as many (or all) of the next document in descending doc_id
    (null ids come last; repeated ids are ordered by a hash of their text; after the last
    document comes the first).
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def report(rows: list[tuple]) -> pa.RecordBatch:
        ids, own, after = (list(x) for x in zip(*rows, strict=True))
        edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(own, after, strict=True)]
        made = [fingerprints_of(texts_of(pa.array(x, pa.large_string()))) for x in (own, edited, after)]
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array(digest), pa.array(made[0], pa.string()), pa.array(made[1], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(made[0], made[1], strict=True)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(made[0], made[2], strict=True)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # the last row of the open bucket, whose successor isn't known yet
        ready: list[tuple] = []
        size = 0
        for batch in small_batches(batches, "text"):
            columns = [batch.column(x).to_pylist() for x in ("doc_id", "text", "bucket", "ghost")]
            for doc_id, text, bucket, ghost in zip(*columns, strict=True):
                text = text or ""
                if waiting is not None and waiting[2] == bucket:
                    ready.append((waiting[0], waiting[1], text))
                    size += len(waiting[1]) + len(text)
                    waiting = None
                if not ghost:
                    waiting = (doc_id, text, bucket)
                if size > 2 << 20:
                    yield report(ready)
                    ready, size = [], 0
        if ready:
            yield report(ready)

    return small_arrow(_with_neighbours(docs)).mapInArrow(run, schema)
