"""MinHash near-duplicate detection (operator 9).

A document's set is the distinct hashes of its shingles of ``words`` words
(words: runs of non-white-space, A-Z lower-cased; fewer words are one shingle).
Documents with equal sets form a class, which one of them, the smallest doc_id,
stands for.  Classes are linked whose similarity ``J >= percent / 100``:

1. One-permutation MinHash with optimal densification, cut into bands; classes
   that agree on a band share a bucket.  Within a bucket each member is paired
   with the smallest member only, so a bucket of n gives n - 1 candidate pairs.
2. Candidate pairs are confirmed on the full sets, unless their sizes alone rule
   a link out.
3. A star can miss a link between two members of which neither is linked to
   its centre.  So the classes that candidate pairs connect at all (confirmed
   or not) form a cluster, and where a cluster fell apart into several
   components, those outside its largest component are compared with all of
   the cluster: in blocks of rows, in vectorised tasks that give back no more
   links than needed to connect their rows.  No pairs are written out, and
   none is left out.

With the bands used, two classes at the threshold share no bucket with
probability below 1e-8.

Defined results: every row is reported, with the component of its own text;
rows that share a doc_id stand for one document wherever its id stands for a
class.  Null doc_ids are never linked and always kept; a document without a
word has no shingle and no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import only_wanted, small_arrow, stage
from nearfield.llm.components import components
from nearfield.llm.kernels import shingle_sets, small_batches, texts_of
from nearfield.llm.minhash import band_keys, signature

#: (bands, bins a band) for a threshold in per cent: a pair at it is missed with a chance below 1e-8.
BANDING = {85: (42, 6), 80: (50, 5)}
#: Partners that are compared with one copy of their centre.
CHUNK = 32
#: Rows and shingles of a block in step 3.
ROWS, SHINGLES = 1024, 1 << 19
_COLUMNS = 4096


def _signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (the set's fingerprint) and bands of each row."""
    bands, rows = BANDING[percent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = list(shingle_sets(texts_of(batch.column("text")), words))
            full = [i for i, s in enumerate(sets) if len(s)]
            digest = np.zeros((len(sets), 2), np.int64)
            for i in full:
                digest[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), "<i8")
            keys = band_keys(np.array([signature(sets[i], bands * rows) for i in full], np.uint64).reshape(-1, bands * rows), bands)
            count = np.zeros(len(sets), np.int32)
            count[full] = bands
            at = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            arrays = [batch.column("doc_id"), sizes, pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.ListArray.from_arrays(at, pa.array(keys.ravel().view(np.int64)))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return small_arrow(docs).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def _confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the candidate pairs (u, v), those whose texts are at least ``percent`` alike.

    The partners of a centre u are dealt into chunks of about ``CHUNK``, and its
    own text goes to each chunk once, not with every pair.
    """
    pairs = pairs.join(pairs.groupBy("u").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")), "u")
    roles = pairs.select(F.col("v").alias("id"), "u", F.pmod(F.xxhash64("v"), "chunks").alias("chunk"), F.lit(1).alias("kind"))
    centres = pairs.select("u", "chunks").distinct().select(F.col("u").alias("id"), "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"))
    roles = stage(roles.unionByName(centres), "roles")
    rows = only_wanted(docs, "id", roles.select("id")).join(roles.hint("merge"), "id")
    rows = rows.select("u", "chunk", "kind", "id", "text").repartition("u", "chunk").sortWithinPartitions("u", "chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, centre = None, []
        for batch in small_batches(batches, "text", 2 << 20):
            found = []
            places = zip(*(batch.column(x).to_pylist() for x in ("u", "chunk", "kind", "id")), strict=True)
            for (u, number, kind, node), own in zip(places, shingle_sets(texts_of(batch.column("text")), words), strict=True):
                if (u, number) != chunk:
                    chunk, centre = (u, number), []
                if not kind:
                    centre.append(own)
                elif any(_alike(x, own, percent) for x in centre):
                    found.append((u, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], ["u", "v"])

    return small_arrow(rows).mapInArrow(run, "u long, v long")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def link_block(sets: list[np.ndarray], left: np.ndarray, component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows of different components, of which at least one is in
    ``left``; as many as connect what all such links connect."""
    tokens, where = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.flatnonzero(np.bincount(where, minlength=len(tokens)) > 1)  # others are in no intersection
    place = np.full(len(tokens), -1)
    place[shared] = np.arange(len(shared))
    at = place[where]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    queries = np.flatnonzero(left)
    common = np.zeros((len(queries), len(sets)), np.float32)
    for lo in range(0, len(shared), _COLUMNS):
        a, b = np.searchsorted(at, [lo, lo + _COLUMNS])
        dense = np.zeros((len(sets), _COLUMNS), np.float32)
        dense[row[a:b], at[a:b] - lo] = 1
        common += dense[queries] @ dense.T
    size = np.array([len(s) for s in sets])
    overlap = common.astype(np.int64)
    linked = 100 * overlap >= percent * (size[queries][:, None] + size[None, :] - overlap)
    linked &= component[queries][:, None] != component[None, :]
    parent = {c: c for c in component.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = root(int(component[queries[i]])), root(int(component[j]))
        if a != b:
            parent[a] = b
            out.append((int(queries[i]), int(j)))
    return out


def _leftovers(clusters: DataFrame, labels: DataFrame, sizes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v): links that connect components of one cluster (step 3)."""
    rows = clusters.select("node", F.col("component").alias("cluster")).join(labels, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("part"))
    rows = stage(rows.join(sizes.select(F.col("id").alias("node"), "n_shingles"), "node"), "parts")
    parts = rows.groupBy("cluster", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    main = parts.groupBy("cluster").agg(F.max(F.struct("n", "part", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("parts")).where("parts > 1")

    def blocks(n: Column, s: Column) -> Column:
        return F.ceil(F.greatest(n / ROWS, s / SHINGLES))

    main = stage(main.select("cluster", F.col("top.part").alias("main"), blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("lefts"), blocks(F.col("top.n"), F.col("top.s")).alias("rights")), "main")
    rows = rows.join(main, "cluster").withColumn("outside", F.col("part") != F.col("main"))
    number = F.when(F.col("outside"), F.pmod(F.xxhash64("node"), "lefts")).otherwise(F.pmod(F.xxhash64("node"), "rights"))
    # blocks: outer block i with outer block j >= i, and with each block of the main component
    order = F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)
    outer = F.when(
        F.col("outside"),
        F.concat(
            F.transform(order, lambda j: F.struct(F.least(j, F.col("b")).alias("i"), F.greatest(j, F.col("b")).alias("j"))),
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1), lambda j: F.struct(F.col("b").alias("i"), (F.col("lefts") + j).alias("j"))),
        ),
    ).otherwise(F.transform(order, lambda i: F.struct(i.alias("i"), (F.col("lefts") + F.col("b")).alias("j"))))
    rows = stage(rows.withColumn("b", number).select("node", "cluster", "part", F.col("b").alias("own"), "outside", outer.alias("pairs")), "blocks")
    texts = only_wanted(docs, "id", rows.select(F.col("node").alias("id")))
    rows = rows.join(texts.withColumnRenamed("id", "node"), "node").select("node", "cluster", "part", "own", "outside", "text", F.explode("pairs").alias("pair"))
    rows = rows.select("node", "cluster", "part", "text", "pair", (F.col("outside") & (F.col("own") == F.col("pair.i"))).alias("is_left"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = list(shingle_sets(texts_of(table.column("text")), words))
        node = table.column("node").to_numpy()
        found = link_block(sets, table.column("is_left").to_numpy(zero_copy_only=False), table.column("part").to_numpy(), percent)
        return pa.table({"u": pa.array([node[i] for i, _ in found], pa.int64()), "v": pa.array([node[j] for _, j in found], pa.int64())})

    return rows.groupBy("cluster", "pair").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    made = stage(_signatures(docs, words, percent), "signatures")
    known = made.where("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("top"))
    classes = stage(classes.select("k1", "k2", F.col("top.doc_id").alias("id"), F.col("top.n_shingles").alias("n_shingles"), F.col("top.bands").alias("bands")), "classes")

    members = classes.select("id", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "id")
    buckets = stage(members.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("other")).where("centre <> other").select("key", "centre"), "buckets")
    pairs = only_wanted(members, "key", buckets.select("key")).join(buckets.hint("merge"), "key").where("id <> centre")
    pairs = stage(pairs.select(F.col("centre").alias("u"), F.col("id").alias("v")).distinct(), "pairs")

    # a pair whose sizes rule a link out needs no look at its texts; it counts for step 3 still
    sizes = classes.select("id", "n_shingles")
    sized = pairs.join(sizes.select(F.col("id").alias("u"), F.col("n_shingles").alias("n")), "u").join(sizes.select(F.col("id").alias("v"), F.col("n_shingles").alias("m")), "v")
    sized = sized.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("u", "v").distinct()
    texts = docs.withColumnRenamed("doc_id", "id")
    links = stage(_confirm(stage(sized, "sized"), texts, words, percent), "links")

    labels = components(links)
    more = stage(_leftovers(components(pairs), labels, sizes, texts, words, percent), "more")
    if more.limit(1).count():
        labels = components(links.unionAll(more))

    found = classes.select("k1", "k2", "id").join(labels, F.col("id") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "id").alias("component"))
    out = made.drop("bands").join(stage(found, "components").hint("merge"), ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component"))
    out = out.select("doc_id", "n_shingles", F.coalesce(own, "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one row of each component, and every row
    without a doc_id.

    Rows count by themselves, as one doc_id may have several texts.  Of a component
    the row of the smallest doc_id stays; rows without a word make one component
    for each doc_id.
    """
    known = stage(docs.where("doc_id is not null").withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(known.select(F.col("__row").alias("doc_id"), "text"), words, percent)
    found = found.select(F.col("doc_id").alias("__row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"))
    order = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text"), F.col("__row").alias("row"))
    ranked = known.select("__row", order.alias("place")).join(found, "__row")
    wordless = F.when(F.col("component").isNull(), F.col("place.doc_id"))
    kept = ranked.groupBy("component", wordless.alias("wordless")).agg(F.min("place").alias("place")).select(F.col("place.row").alias("__row"))
    return known.join(kept, "__row", "left_semi").drop("__row").unionByName(docs.where("doc_id is null"))
