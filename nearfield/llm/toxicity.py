"""Toxicity (operator 4): logistic regression trained by FTRL-proximal.

Features of a text are the presence of hashed word uni- and bigrams and of
skip-grams (two words with one or two words between them); words are runs of
ASCII digits, letters and anything beyond ASCII, A-Z lower-cased.  FTRL-proximal
keeps a learning rate for each coordinate and an L1 penalty, so most weights
are exactly zero and the rest, at most ``2**HASH_BITS`` of them, are broadcast.

The classifier is fitted on a bounded sample: the first ``PER_CLASS`` labelled
documents of each class in the order of a hash of their id, or as many of them
as have ``FEATURE_BYTES`` of features (one at least).  The intercept is then corrected to the classes' shares among all labelled documents.

Defined results: null labels are left out; of several labels for one id the
largest counts, of several texts the smallest; a null or empty text gets the score of the intercept; without
any labelled text every score is 0.25, a smoothed share.  Rows are scored one by
one, also where ids repeat or are null; other columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import small_arrow
from nearfield.llm.kernels import ALNUM, U64, Texts, lower, mix64, seeds, small_batches, texts_of, word_hashes, words_of

HASH_BITS = 20
PER_CLASS = 4096
FEATURE_BYTES = 32 << 20
EPOCHS = 5
#: L1 and ALPHA: the least log loss of twelve settings, by the four folds crc32(doc_id) mod 5 = 1 to 4 of the training rows.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
#: Distance between the two words of a pair; 1 is a bigram, 2 and 3 are skip-grams.
PAIRS = (1, 2, 3)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hashed_features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram of a batch; a feature may repeat within a row."""
    low = lower(texts)
    words = words_of(low, ALNUM)
    h = word_hashes(low.buf, words)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), words.last - words.first)
    multiply = seeds(len(PAIRS) + 1, 5)
    rows, features = [row], [mix64(h * multiply[0])]
    for kind, gap in enumerate(PAIRS, 1):
        same = row[gap:] == row[:-gap]
        rows.append(row[gap:][same])
        features.append(mix64(h[:-gap] * multiply[kind] + h[gap:])[same])
    shift = U64(64 - HASH_BITS)
    return np.concatenate(rows), (np.concatenate(features) >> shift).astype(np.int32)


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    intercept: float

    def scores(self, texts: Texts) -> np.ndarray:
        rows, features = hashed_features(texts)
        dense = np.zeros(1 << HASH_BITS, np.float32)
        dense[self.index] = self.weight
        heavy = np.flatnonzero(dense[features])
        pair = np.unique(rows[heavy].astype(np.int64) << HASH_BITS | features[heavy])  # presence
        total = np.bincount(pair >> HASH_BITS, weights=dense[pair & ((1 << HASH_BITS) - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -35, 35)))


def fit(examples: list[tuple[np.ndarray, int]], share: float) -> Model:
    """FTRL-proximal over (distinct features, label); ``share`` is the positives' share in the population."""
    size = 1 << HASH_BITS
    if not examples:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), _logit(share))
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            x, y = examples[i]
            zx, nx = z[x], n[x]
            rate = (BETA + np.sqrt(nx)) / ALPHA
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / (rate + L2))
            bias = -bias_z * ALPHA / (BETA + math.sqrt(bias_n))
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()) + bias)))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    kept = np.flatnonzero(w)
    seen = sum(y for _, y in examples)
    bias = -bias_z * ALPHA / (BETA + math.sqrt(bias_n))
    bias += _logit(share) - _logit((seen + 0.5) / (len(examples) + 2))
    return Model(kept.astype(np.int32), w[kept].astype(np.float32), bias)


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the ``toxic`` labels of documents that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, total = counts.get(1, 0), sum(counts.values())
    share = (pos + 0.5) / (total + 2)
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = known.where("y = 1").orderBy(*by_hash).limit(PER_CLASS).union(known.where("y = 0").orderBy(*by_hash).limit(PER_CLASS))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            rows, features = hashed_features(texts_of(batch.column("text")))
            pair = np.unique(rows.astype(np.int64) << HASH_BITS | features)
            cut = np.searchsorted(pair >> HASH_BITS, np.arange(batch.num_rows + 1))
            low = (pair & ((1 << HASH_BITS) - 1)).astype("<i4")
            blobs = [low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(blobs, pa.binary())], ["doc_id", "y", "features"])

    # at most 2 * PER_CLASS ids of eight bytes are broadcast
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = small_arrow(texts).mapInArrow(featurise, f"doc_id {kind}, y int, features binary")
    before = Window.partitionBy("y").orderBy(*by_hash)
    rows = rows.select("doc_id", "y", "features", F.sum(F.length("features")).over(before).alias("size"), F.row_number().over(before).alias("place"))
    rows = rows.where((F.col("size") <= FEATURE_BYTES) | (F.col("place") == 1)).select("doc_id", "y", "features").repartition(1).sortWithinPartitions("doc_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = fit([(np.frombuffer(x.as_py(), "<i4"), y.as_py()) for batch in batches for x, y in zip(batch.column("features"), batch.column("y"), strict=True)], share)
        yield pa.RecordBatch.from_arrays([pa.array([made.index.tobytes()], pa.binary()), pa.array([made.weight.tobytes()], pa.binary()), pa.array([made.intercept])], ["index", "weight", "intercept"])

    # one task fits, on the bounded sample; the driver gets the weights that aren't zero
    made = small_arrow(rows).mapInArrow(learn, "index binary, weight binary, intercept double").first()
    return Model(np.frombuffer(made["index"], np.int32), np.frombuffer(made["weight"], np.float32), made["intercept"]) if made else fit([], share)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out`` added."""
    fields = [x for x in docs.columns if x != out]
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, 1 << 20):
            made = handle.value.scores(texts_of(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in fields), pa.array(made, pa.float64())], [*fields, out])

    return small_arrow(docs).mapInArrow(run, docs.drop(out).schema.add(out, "double"))
