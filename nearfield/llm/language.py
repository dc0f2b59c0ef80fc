"""Language identification (operator 6): character Kneser-Ney models.

A text is read as its letters, lower-cased, with every stretch of anything else
as one space.  For each language an interpolated Kneser-Ney model of order
``ORDER`` is estimated from the counts of all training documents: the highest
order uses counts, lower orders the number of different left neighbours, with
one absolute discount for each order from its counts of counts.  A gram is a
packed integer of 12 bits a character (letters beyond U+07FF share 2,048
codes).  A text gets the language of the lowest cross-entropy per character.

All counts are kept, and Spark estimates from them: discounts, back-off weights
of contexts, and each order's probabilities from the order below.  They are
stored as entries that add up: a gram's log probability in a language is the
sum of the entries of its suffixes and of its contexts, where a missing entry
is 0.  An entry of a gram is its log probability less what its context and its
suffix give already; one of a context is its log back-off weight.  As sums can
be taken in parts, entries are dealt by hash to shards of about ``MAX_GRAMS``
each, which go to the executors one by one; where there are several, a process
holds one at a time.  Their number follows the corpus, the result does not
depend on it.

Defined results: ``und`` with score 0 for a null text or one without a letter,
or if nothing could be learned; the score is the language's posterior under a
temperature, and ``rejected`` tells that the cross-entropy lies beyond what the
training documents of that language show, all of which are scored for that.
Ties go to the smaller language name.  Rows with null ids are treated like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import small_arrow, stage
from nearfield.llm.kernels import small_batches

ORDER = 4
CODE_BITS = 12
MAX_GRAMS = 4_000_000
TEMPERATURE = 40.0
_BLOCK = 1 << 20


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _table() -> np.ndarray:
    codes = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or not chr(c).isalpha():
            continue
        low = ord(chr(c).lower()[0])
        codes[c] = low if low < 0x800 else 0x800 + (low * 2654435761 >> 7) % 0x800
    return codes


_codes: list[np.ndarray] = []


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the texts, each with a space (0) before and after it, and where each text begins."""
    if not _codes:
        _codes.append(_table())
    joined = " ".join(x or "" for x in texts) + " "
    raw = _codes[0][np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    begin = np.concatenate([[0], np.cumsum([len(x or "") + 1 for x in texts])])
    keep = np.empty(len(raw), bool)
    keep[0] = True
    keep[1:] = (raw[1:] != 0) | (raw[:-1] != 0)
    codes = raw[keep]
    place = np.concatenate([[0], np.cumsum(keep)])
    return codes.astype(np.uint64), place[begin]


def grams(codes: np.ndarray, begin: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed gram that ends at each character, and which lie within one text."""
    key = codes.copy()
    for j in range(1, order):
        key[j:] |= codes[:-j] << np.uint64(CODE_BITS * j)
    inside = np.ones(len(codes), bool)
    for j in range(order - 1):
        at = begin[:-1] + j
        inside[at[at < np.minimum(begin[1:], len(codes))]] = False
    return key, inside


class _Scorer:
    """What has log probabilities for grams of the highest order scores texts."""

    languages: list[str]

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, language) cross-entropies per character, and the numbers of letters."""
        codes, begin = characters(texts)
        key, inside = grams(codes, begin, ORDER)
        total = np.zeros((len(texts), len(self.languages)))
        block = max(_BLOCK >> 4, 4 * _BLOCK // max(4, len(self.languages)))
        for a in range(0, len(key), block):
            where = a + np.flatnonzero(inside[a : a + block])
            if not len(where):
                continue
            distinct, at = np.unique(key[where], return_inverse=True)
            log = self.log_probabilities(distinct)[at]
            text = np.searchsorted(begin, where, "right") - 1
            cut = np.flatnonzero(np.diff(text, prepend=-1))
            total[text[cut]] += np.add.reduceat(log, cut, axis=0, dtype=np.float64)
        count = np.concatenate([[0], np.cumsum(inside)])
        n = np.diff(count[np.minimum(begin, len(codes))])
        letters = np.concatenate([[0], np.cumsum(codes > 0)])
        return -total / np.maximum(n, 1)[:, None], np.diff(letters[np.minimum(begin, len(codes))])


@dataclass
class Model(_Scorer):
    """A model in one process, from ``estimate``; ``train`` gives a ``ShardedModel``."""

    languages: list[str]
    keys: list[np.ndarray]  # of order 1, 2, ...
    logs: list[np.ndarray]  # (gram, language)
    contexts: list[np.ndarray]  # of order 1, 2, ...: contexts of grams one longer
    back_off: list[np.ndarray]  # (context, language): log weights
    unseen: np.ndarray  # log probability of a character that no model knows

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        """(gram, language) for grams of the highest order."""
        out = np.zeros((len(key), len(self.languages)), np.float32)
        todo, rest = np.arange(len(key)), key
        for order in range(len(self.keys), 0, -1):
            at, known = _find(self.keys[order - 1], rest)
            out[todo[known]] += self.logs[order - 1][at[known]]
            todo, rest = todo[~known], rest[~known]
            if not len(todo):
                return out
            if order > 1:
                at, known = _find(self.contexts[order - 2], rest >> np.uint64(CODE_BITS))
                out[todo[known]] += self.back_off[order - 2][at[known]]
                rest = rest & np.uint64((1 << CODE_BITS * (order - 1)) - 1)
        out[todo] += self.unseen
        return out


@dataclass
class Shard:
    """Entries by sorted feature: those of ``features[i]`` are ``first[i]:first[i + 1]``."""

    features: np.ndarray
    first: np.ndarray
    language: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(features: np.ndarray, language: np.ndarray, value: np.ndarray) -> Shard:
        order = np.argsort(features)
        distinct, first = np.unique(features[order], return_index=True)
        return Shard(distinct, np.append(first, len(order)), language[order].astype(np.int32), value[order].astype(np.float32))

    def add(self, wanted: np.ndarray, to: np.ndarray) -> None:
        """Add the entries of each wanted feature to its row of (gram, language)."""
        at, known = _find(self.features, wanted)
        row, at = np.flatnonzero(known), at[known]
        n = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        to[np.repeat(row, n), self.language[entry]] += self.value[entry]


def _feature(key: np.ndarray, order: int, context: bool) -> np.ndarray:
    """What entries are found by: a gram, its order and whether it is meant as a context."""
    return key.astype(np.int64) | ((order << 1 | context) << CODE_BITS * ORDER)


@dataclass
class ShardedModel(_Scorer):
    languages: list[str]
    unseen: float  # log probability of a character that no model knows
    shards: list[Broadcast]  # of Shard
    limits: np.ndarray | None = None  # cross-entropy beyond which a language is rejected

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        """(gram, language) for grams of the highest order."""
        out = np.full((len(key), len(self.languages)), self.unseen, np.float64)
        wanted = []
        for order in range(1, ORDER + 1):
            suffix = key & np.uint64((1 << CODE_BITS * order) - 1)
            wanted.append(_feature(suffix, order, False))
            if order > 1:
                wanted.append(_feature(suffix >> np.uint64(CODE_BITS), order - 1, True))
        for handle in self.shards:
            shard = handle.value
            for features in wanted:
                shard.add(features, out)
            if len(self.shards) > 1:  # bounded memory: read again when it is needed again
                handle.__dict__.pop("_value", None)
        return out.astype(np.float32)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def estimate(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The models of all languages from sorted highest-order keys and their counts, in one process."""
    languages = sorted(counts)
    per_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for name in languages:
        keys, n = counts[name]
        per_order[ORDER - 1].append((keys, n.astype(np.float64)))
        for order in range(ORDER - 1, 0, -1):  # how many different characters stand before each shorter gram
            keys, n = np.unique(keys & np.uint64((1 << CODE_BITS * order) - 1), return_counts=True)
            per_order[order - 1].append((keys, n.astype(np.float64)))
    alphabet = max(2, len(np.unique(np.concatenate([k for k, _ in per_order[0]]))) + 1) if languages else 2
    model = Model(languages, [], [], [], [], np.full(len(languages), -np.log(alphabet), np.float32))
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([k for k, _ in per_order[order - 1]])) if languages else np.zeros(0, np.uint64)
        context_union = np.unique(union >> np.uint64(CODE_BITS))
        logs = np.empty((len(union), len(languages)), np.float32)
        weights = np.zeros((len(context_union), len(languages)), np.float32)
        lower = _lower(model, union, order)
        context_of = np.searchsorted(context_union, union >> np.uint64(CODE_BITS))
        for j, (keys, n) in enumerate(per_order[order - 1]):
            ones, twos = int((n == 1).sum()), int((n == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            at, known = _find(keys, union)
            c = np.where(known, n[at], 0.0) if len(keys) else np.zeros(len(union))
            total = np.bincount(context_of, c, len(context_union))
            types = np.bincount(context_of, c > 0, len(context_union))
            weight = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
            share = np.maximum(c - discount, 0) / np.maximum(total, 1)[context_of]
            logs[:, j] = np.log(share + weight[context_of] * np.exp(lower[:, j]))
            weights[:, j] = np.log(weight)
        model.keys.append(union)
        model.logs.append(logs)
        if order > 1:
            model.contexts.append(context_union)
            model.back_off.append(weights)
    return model


def _lower(model: Model, union: np.ndarray, order: int) -> np.ndarray:
    if order == 1:
        return np.broadcast_to(model.unseen, (len(union), len(model.languages)))
    return model.log_probabilities(union & np.uint64((1 << CODE_BITS * (order - 1)) - 1))


def train(docs: DataFrame) -> ShardedModel:
    """The model of every language of the documents that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in small_batches(batches, "text"):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                codes, begin = characters([t for t, x in zip(texts, langs, strict=True) if x == lang])
                key, inside = grams(codes, begin, ORDER)
                held.setdefault(lang, []).append(np.unique(key[inside], return_counts=True))
                size += len(held[lang][-1][0])
            if size > 4_000_000:
                for lang, parts in held.items():
                    held[lang] = [merged(parts)]
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > 2_000_000:  # bounded memory: what is counted so far goes out
                    yield from told()
                    held, size = {}, 0
        yield from told()

    counted = stage(small_arrow(known).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    model = _estimated(counted)
    _calibrate(model, known)
    return model


def _estimated(counted: DataFrame) -> ShardedModel:
    """The models of all languages from (lang, gram, n), by Spark."""
    spark = counted.sparkSession
    languages = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if not languages:
        return ShardedModel([], 0.0, [])
    numbers = spark.createDataFrame(list(enumerate(languages)), "at int, lang string")
    tables = {ORDER: counted.join(F.broadcast(numbers), "lang").select("at", "gram", "n")}
    for order in range(ORDER - 1, 0, -1):  # how many different characters stand before each shorter gram
        shorter = F.col("gram").bitwiseAND((1 << CODE_BITS * order) - 1)
        tables[order] = stage(tables[order + 1].groupBy("at", shorter.alias("gram")).agg(F.count("*").alias("n")), "grams")
    discounts = {order: _discounts(table) for order, table in tables.items()}

    # characters, of which a language has at most 1 << CODE_BITS, are estimated here
    table = tables[1].toArrow()
    at, gram, n = (table.column(x).to_numpy() for x in ("at", "gram", "n"))
    alphabet, where = np.unique(gram, return_inverse=True)
    unseen = -np.log(max(2, len(alphabet) + 1))
    counts = np.zeros((len(languages), len(alphabet)))
    counts[at, where] = n
    discount = np.array([discounts[1].get(j, 0.5) for j in range(len(languages))])[:, None]
    total = counts.sum(axis=1, keepdims=True)
    log = np.log((np.maximum(counts - discount, 0) + discount * (counts > 0).sum(axis=1, keepdims=True) * np.exp(unseen)) / total)
    lower = pa.table({"at": pa.array(at, pa.int32()), "suffix": pa.array(gram, pa.int64()), "below": pa.array(log[at, where])})
    lower, entries = spark.createDataFrame(lower), None

    for order in range(2, ORDER + 1):
        own = F.col("discount")
        context, suffix = F.shiftright("gram", CODE_BITS), F.col("gram").bitwiseAND((1 << CODE_BITS * (order - 1)) - 1)
        beside = Window.partitionBy("at", "context")
        known = spark.createDataFrame([(j, discounts[order].get(j, 0.5)) for j in range(len(languages))], "at int, discount double")
        rows = tables[order].withColumn("context", context).withColumn("total", F.sum("n").over(beside)).withColumn("weight", F.count("*").over(beside) / F.col("total"))
        rows = rows.join(F.broadcast(known), "at").withColumn("weight", own * F.col("weight")).withColumn("suffix", suffix).join(lower, ["at", "suffix"])
        share = F.greatest(F.col("n") - own, F.lit(0.0)) / F.col("total")
        rows = rows.select("at", "gram", "context", F.log("weight").alias("weight"), "below", F.log(share + F.col("weight") * F.exp("below")).alias("log"))
        rows = stage(rows, f"order{order}")
        lower = rows.select("at", F.col("gram").alias("suffix"), F.col("log").alias("below"))
        tag = order << 1 << CODE_BITS * ORDER
        made = rows.select((F.col("gram") + F.lit(tag)).alias("feature"), "at", (F.col("log") - F.col("weight") - F.col("below")).cast("float").alias("value"))
        tag = ((order - 1) << 1 | 1) << CODE_BITS * ORDER
        made = made.unionAll(rows.groupBy("at", "context").agg(F.first("weight").alias("weight")).select((F.col("context") + F.lit(tag)).alias("feature"), "at", F.col("weight").cast("float")))
        entries = made if entries is None else entries.unionAll(made)

    # that shards can be read one by one: each file has its rows by shard
    shards = max(1, -(-entries.count() // MAX_GRAMS))
    entries = stage(entries.withColumn("shard", F.pmod(F.xxhash64("feature"), F.lit(shards))).sortWithinPartitions("shard"), "entries")
    single = (_feature(np.tile(alphabet, len(languages)), 1, False), np.repeat(np.arange(len(languages)), len(alphabet)), (log - unseen).ravel())
    handles = []
    for k in range(shards):
        table = entries.where(F.col("shard") == k).select("feature", "at", "value").toArrow()
        parts = [tuple(table.column(x).to_numpy() for x in ("feature", "at", "value"))] + [single] * (k == 0)
        handles.append(spark.sparkContext.broadcast(Shard.of(*(np.concatenate(x) for x in zip(*parts, strict=True)))))
    return ShardedModel(languages, unseen, handles)


def _discounts(table: DataFrame) -> dict[int, float]:
    """Each language's absolute discount, from how many grams have the counts 1 and 2."""
    seen = table.groupBy("at").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"))
    return {r["at"]: r.ones / (r.ones + 2 * r.twos) for r in seen.where("ones > 0 and twos > 0").collect()}


def _calibrate(model: ShardedModel, known: DataFrame) -> None:
    """A language's limit: four deviations above the mean of all its training texts that have a gram."""
    number = {lang: j for j, lang in enumerate(model.languages)}
    model.limits = np.full(len(number), np.inf)
    if not number:
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            entropy, _ = model.entropies(batch.column("text").to_pylist())
            at = np.array([number.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)  # not learned: none of its texts has a gram
            own = entropy[np.arange(len(at)), at]
            ok = (at >= 0) & (own != 0)
            yield pa.RecordBatch.from_arrays([pa.array(at[ok], pa.int64()), pa.array(own[ok])], ["at", "entropy"])

    found = small_arrow(known.select("lang", "text")).mapInArrow(run, "at long, entropy double").groupBy("at").agg(F.avg("entropy").alias("m"), F.stddev_pop("entropy").alias("s")).collect()
    for r in found:
        model.limits[r["at"]] = r.m + 4 * max(r.s, 0.05)


def predict(docs: DataFrame, model: ShardedModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected added."""
    names = ["lang_pred", "score", "rejected"]
    fields = [x for x in docs.columns if x not in names]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            n = batch.num_rows
            pred, score, rejected = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            if model.languages:
                entropy, letters = model.entropies(batch.column(text).to_pylist())
                best = entropy.argmin(axis=1)
                low = entropy[np.arange(n), best]
                posterior = 1 / np.exp(np.clip((low[:, None] - entropy) * TEMPERATURE, -50, 0)).sum(axis=1)
                ok = letters > 0
                pred[ok] = np.array(model.languages, object)[best[ok]]
                score[ok] = posterior[ok]
                rejected[ok] = low[ok] > model.limits[best[ok]]
            made = [pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in fields), *made], [*fields, *names])

    schema = docs.drop(*names).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return small_arrow(docs).mapInArrow(run, schema)
