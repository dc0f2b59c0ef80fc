"""Suffix-array deduplication (operator 10): repeated byte strings.

A byte is repeated if it lies in a string of ``length`` bytes that also starts
anywhere else, in the same or another text.  Which strings (windows) are
repeated is found exactly, from sorted suffixes, with anchors to keep them few:

1. Each window has one anchor: the place of its smallest hashed gram of
   ``length / 4`` bytes.  It depends on the window's bytes alone, so equal
   windows have equal anchors at equal offsets.  Windows of one anchor are
   neighbours; their union is the anchor's span (at most about two windows).
2. Anchors are counted by their gram.  A gram that occurs once has no repeated
   window.  Anchors with equal spans form a class; a class with two members is
   repeated in full, and a gram with one class is decided by that.
3. For grams with several classes one span of each class is fetched.  In each
   task the suffixes that start at the anchors, and the reversed prefixes that
   end there, are sorted by deep-shallow sorting.  Where the suffixes' common
   prefixes reach ``length - o`` and the prefixes' common suffixes reach o,
   classes share the window at offset o: those in one run of both arrays.
4. A gram with more than ``HOT`` classes isn't sorted in one task.  Its bucket
   key is lengthened to the whole window, so that equal windows, combined
   before the shuffle, meet wherever their key is dealt.

No step holds all rows of a gram, text or window in one task.  Span identity is
by 128 bits of hash, everything else by comparing bytes.

Defined results: a null text is empty; texts shorter than ``length`` have no
window; equal rows are copies of each other, so all their windows are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import only_last_stays, only_wanted, small_arrow, stage
from nearfield.llm.kernels import U64, Texts, mix64, seeds, small_batches, texts_of
from nearfield.llm.suffix_sort import deep_shallow

HOT = 256
_TOGETHER = 2000
_OFFSETS = 16
_NO_ID = -(1 << 63)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = seeds(256, 3)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for j, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(n, base, U64)
            factors[0] = 1
            _powers[j] = np.cumprod(factors, dtype=U64)
    return _powers[0], _powers[1]


def anchors(texts: Texts, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, least offset, largest offset, gram hash) of the windows of each text.

    A window that starts at p has offset anchor - p.
    """
    buf, gram = texts.buf, length // 4
    long = np.flatnonzero(texts.end - texts.start >= length)
    none = np.zeros(0, np.int64)
    if not len(long):
        return none, none, none, none, none.astype(U64)
    n, width = len(buf), length - gram + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTES[buf] * up[:n], out=sums[1:])
    h = mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    bits = U64(int(n).bit_length())
    ranked = (h >> bits << bits) | np.arange(len(h), dtype=U64)
    blocks = np.full(-(-len(h) // width) * width, ~U64(0), U64)
    blocks[: len(h)] = ranked
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = texts.end[long] - texts.start[long] - length + 1
    text = np.repeat(np.arange(len(long)), count)
    p = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(texts.start[long], count)
    at = (np.minimum(behind[p], ahead[p + width - 1]) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    fresh = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(fresh[1:], len(p)) - 1
    where = at[fresh]
    return long[text[fresh]], where, where - p[last], where - p[fresh], h[where]


ANCHORS = "rid long, th long, pos int, omin int, omax int, gram long, span long"


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            texts = texts_of(batch.column("text"))
            text, at, least, most, gram = anchors(texts, length)
            view = memoryview(np.ascontiguousarray(texts.buf))
            digest = xxhash.xxh3_64_intdigest
            span = [digest(view[i - b : i - a + length], a << 32 | b) for i, a, b in zip(at.tolist(), least.tolist(), most.tolist(), strict=True)]
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid").take(rows), batch.column("th").take(rows), pa.array((at - texts.start[text]).astype(np.int32)), pa.array(least.astype(np.int32)), pa.array(most.astype(np.int32)),
                    pa.array(gram.view(np.int64)), pa.array(np.array(span, U64).view(np.int64)),
                ],
                [x.split()[0] for x in ANCHORS.split(", ")],
            )

    return small_arrow(docs.select("rid", "th", "text").where(F.octet_length("text") >= length)).mapInArrow(run, ANCHORS)


CONTEXTS = "gram long, span long, copies long, omin int, omax int, hot boolean, before binary, after binary"


def _contexts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes around one anchor of each class: reversed before it, and from it on."""
    by_text = wanted.groupBy(F.col("rid").alias(_RID), F.col("th").alias(_TH)).agg(F.collect_list(F.struct("gram", "span", "copies", "omin", "omax", "hot", "pos")).alias("__nf_classes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = texts_of(batch.column("text"))
            lists = batch.column("__nf_classes")
            flat = lists.flatten()
            text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
            pos, least, most = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("pos", "omin", "omax"))
            start = texts.start[text] + pos
            raw = texts.buf.tobytes()
            before = [raw[i - b : i][::-1] for i, b in zip(start.tolist(), most.tolist(), strict=True)]
            after = [raw[i : i - a + length] for i, a in zip(start.tolist(), least.tolist(), strict=True)]
            names = [x.split()[0] for x in CONTEXTS.split(", ")]
            yield pa.RecordBatch.from_arrays([*(flat.field(x) for x in names[:6]), pa.array(before, pa.binary()), pa.array(after, pa.binary())], names)

    return small_arrow(rows.join(by_text, [_RID, _TH])).mapInArrow(run, CONTEXTS)


def shared_offsets(before: list[bytes], after: list[bytes], copies: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> list[list[int]]:
    """For each class the offsets whose window is repeated, as [first, last, first, last, ...]."""
    n = len(before)
    right, right_lcp = deep_shallow(after)
    left, left_lcp = deep_shallow(before)
    marked = np.zeros((n, int(most.max()) + 2), bool)
    for o in range(int(least.min()), int(most.max()) + 1):
        active = (least <= o) & (o <= most)
        if int(active.sum()) < 2:
            continue
        run_right, run_left = np.empty(n, np.int64), np.empty(n, np.int64)
        run_right[right] = np.cumsum(right_lcp < length - o)
        run_left[left] = np.cumsum(left_lcp < o) if o else 0
        rows = np.flatnonzero(active)
        key = run_right[rows] * (n + 1) + run_left[rows]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        both = np.zeros(len(rows), bool)
        both[order[1:]] |= same
        both[order[:-1]] |= same
        marked[rows[both], o] = True
    for i in np.flatnonzero(copies > 1):
        marked[i, least[i] : most[i] + 1] = True
    edge = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 0))), axis=1)
    out = []
    for i in range(n):
        first, last = np.flatnonzero(edge[i] == 1), np.flatnonzero(edge[i] == -1) - 1
        out.append(np.stack([first, last], axis=1).ravel().tolist())
    return out


DECIDED = "gram long, span long, offsets array<int>"


def _decided(batch: pa.Table, length: int) -> pa.RecordBatch:
    columns = [batch.column(x).combine_chunks() if isinstance(batch.column(x), pa.ChunkedArray) else batch.column(x) for x in ("gram", "span", "copies", "omin", "omax", "before", "after")]
    copies, least, most = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in columns[2:5])
    offsets = shared_offsets(columns[5].to_pylist(), columns[6].to_pylist(), copies, least, most, length)
    return pa.RecordBatch.from_arrays([columns[0], columns[1], pa.array(offsets, pa.list_(pa.int32()))], ["gram", "span", "offsets"])


def _sorted_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """Decides the classes of grams that aren't hot, some grams at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            grams = batch.column("gram").to_numpy()
            first = 0
            if held and held[-1].column("gram")[-1].as_py() != grams[0] and rows >= _TOGETHER:
                yield _decided(pa.Table.from_batches(held), length)
                held, rows = [], 0
            for cut in (np.flatnonzero(np.diff(grams)) + 1).tolist():  # a gram's rows stand together
                if rows + cut - first >= _TOGETHER:
                    yield _decided(pa.Table.from_batches([*held, batch.slice(first, cut - first)]), length)
                    held, rows, first = [], 0, cut
            held.append(batch.slice(first))
            rows += batch.num_rows - first
        if held:
            yield _decided(pa.Table.from_batches(held), length)

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small_arrow(contexts.repartition(parts, "gram").sortWithinPartitions("gram")).mapInArrow(run, DECIDED)


def _whole_windows(contexts: DataFrame, length: int) -> DataFrame:
    """Decides the classes of hot grams, by keys that lengthen up to whole windows.

    Offsets are taken in blocks.  All windows of a block share its core, and its
    hull holds them all.  Equal hulls are combined; a core with one hull is
    decided by how often that occurs.  Only for cores with several hulls are the
    windows keyed one by one, once for each hull.
    """
    contexts = stage(contexts.select("gram", "span", "copies", "omin", "omax", "before", "after"), "contexts")
    digest = xxhash.xxh3_128_digest
    class_names = ["gram", "span"]

    def pair(keys: list[bytes], j: int) -> pa.Array:
        return pa.array(np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)[:, j].copy())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                row, first, last, cores, hulls = [], [], [], [], []
                for i, (least, most, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("omin", "omax", "before", "after")), strict=True)):
                    span = x[::-1] + y
                    for low in range(least // _OFFSETS * _OFFSETS, most + 1, _OFFSETS):
                        high = low + _OFFSETS - 1
                        a, b = max(low, least), min(high, most)
                        row.append(i)
                        first.append(a)
                        last.append(b)
                        cores.append(digest(span[most - low : most - high + length], low))
                        hulls.append(digest(span[most - b : most - a + length], a << 16 | b))
                columns = [*(batch.column(c).take(pa.array(row, pa.int32())) for c in (*class_names, "copies")), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
                columns += [pair(cores, 0), pair(cores, 1), pair(hulls, 0), pair(hulls, 1)]
                yield pa.RecordBatch.from_arrays(columns, [*class_names, "copies", "first", "last", "c1", "c2", "h1", "h2"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                row, offset, copies, keys = [], [], [], []
                for i, (most, x, y, opened) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("omax", "before", "after", "opened")), strict=True)):
                    span = x[::-1] + y
                    for block in opened:
                        for o in range(block["first"], block["last"] + 1):
                            row.append(i)
                            offset.append(o)
                            copies.append(block["n"])
                            keys.append(digest(span[most - o : most - o + length]))
                columns = [*(batch.column(c).take(pa.array(row, pa.int32())) for c in class_names), pa.array(offset, pa.int32()), pa.array(copies, pa.int64()), pair(keys, 0), pair(keys, 1)]
                yield pa.RecordBatch.from_arrays(columns, [*class_names, "o", "n", "w1", "w2"])

    rows = stage(small_arrow(contexts).mapInArrow(blocks, "gram long, span long, copies long, first int, last int, c1 long, c2 long, h1 long, h2 long"), "blocks")
    hulls = rows.groupBy("h1", "h2").agg(F.sum("copies").alias("n"), F.min(F.struct("gram", "span", "first", "last", "c1", "c2")).alias("p"))
    hulls = stage(hulls.select("h1", "h2", "n", "p.*"), "hulls")
    whole = rows.join(stage(hulls.where("n > 1").select("h1", "h2"), "repeated"), ["h1", "h2"]).select("gram", "span", F.array("first", "last").alias("offsets"))
    cores = stage(hulls.groupBy("c1", "c2").agg(F.count("*").alias("hulls")).where("hulls > 1").select("c1", "c2"), "cores")
    opened = hulls.join(cores, ["c1", "c2"]).groupBy("gram", "span").agg(F.collect_list(F.struct("first", "last", "n")).alias("opened"))  # at most length / _OFFSETS
    keyed = stage(small_arrow(contexts.join(stage(opened, "opened"), ["gram", "span"])).mapInArrow(windows, "gram long, span long, o int, n long, w1 long, w2 long"), "windows")
    seen = stage(keyed.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2"), "windows-seen")
    # a hull that occurs once is of one class, the one that its windows were keyed for
    single = keyed.where("n = 1").join(seen, ["w1", "w2"]).select("gram", "span", F.array("o", "o").alias("offsets"))
    return whole.unionByName(single)


#: Names of columns added on the way; no table is expected to have them.
SPANS, _RID, _TH = "__nf_spans", "__nf_rid", "__nf_th"


def with_spans(docs: DataFrame, *lengths: int) -> DataFrame:
    """``docs`` with SPANS: repeated byte runs (b, e) of each text, sorted; they may overlap.

    A second, third length is answered in the columns SPANS_1, SPANS_2.  All parts
    of a repeated string are repeated too, so a length is sought only in texts
    with a run of so many bytes at the next shorter one.
    """
    rows = docs.withColumn("text", docs["text"].cast("string"))
    rows = rows.withColumns({_RID: F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)), _TH: F.xxhash64("text")})
    names = [f"{SPANS}_{i}" if i else SPANS for i in range(len(lengths))]
    out = within = rows
    shorter = None
    for length, name in sorted(zip(lengths, names, strict=True)):
        if shorter is not None:
            wanted = shorter.where(_longest(F.col("__nf_parts")) >= length).select(F.xxhash64(_RID, _TH).alias("key"))
            within = only_wanted(rows.withColumn("__nf_key", F.xxhash64(_RID, _TH)), "__nf_key", wanted).drop("__nf_key")
        with only_last_stays():
            shorter = stage(_repeats(within, length), "spans")
        out = out.join(shorter.withColumnRenamed("__nf_parts", name), [_RID, _TH], "left")
    none = F.array().cast("array<struct<b:int,e:int>>")
    return out.select(*docs.columns, *(F.coalesce(x, none).alias(x) for x in names))


def _longest(parts: Column) -> Column:
    """Bytes of the longest run that sorted parts (b, e) cover together."""

    def add(run: Column, part: Column) -> Column:
        goes_on = part["b"] <= run["e"]
        b = F.when(goes_on, run["b"]).otherwise(part["b"])
        e = F.when(goes_on, F.greatest(run["e"], part["e"])).otherwise(part["e"])
        return F.struct(b.alias("b"), e.alias("e"), F.greatest(run["most"], e - b).alias("most"))

    none = F.struct(F.lit(0).alias("b"), F.lit(-1).alias("e"), F.lit(0).alias("most"))
    return F.aggregate(parts, none, add, lambda run: run["most"])


def _repeats(rows: DataFrame, length: int) -> DataFrame:
    """The repeated runs of each text that has any, by _RID and _TH."""
    found = _anchor_rows(rows.select(F.col(_RID).alias("rid"), F.col(_TH).alias("th"), "text"), length)
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi"))
    grams = stage(grams.where("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed")), "grams")
    found = stage(found.join(grams, "gram"), "anchors")
    whole = found.where("not mixed").select("rid", "th", (F.col("pos") - F.col("omax")).alias("b"), (F.col("pos") - F.col("omin") + length).alias("e"))

    place = F.struct("rid", "th", "pos", "omin", "omax")
    classes = stage(found.where("mixed").groupBy("gram", "span").agg(F.count("*").alias("copies"), F.min(place).alias("p")).select("gram", "span", "copies", "p.*"), "classes")
    many = stage(classes.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("gram", F.lit(True).alias("hot")), "hot")
    wanted = stage(classes.join(many, "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "wanted")
    decided = _sorted_buckets(_contexts(rows, wanted.where("not hot"), length), length)
    if many.limit(1).count():
        decided = decided.unionByName(_whole_windows(_contexts(rows, wanted.where("hot"), length), length))
    back = found.where("mixed").join(decided, ["gram", "span"]).select("rid", "th", "pos", F.explode(_pairs(F.col("offsets"))).alias("o"))
    back = back.select("rid", "th", (F.col("pos") - F.col("o.last")).alias("b"), (F.col("pos") - F.col("o.first") + length).alias("e"))
    spans = whole.unionByName(back).groupBy("rid", "th").agg(F.sort_array(F.collect_list(F.struct("b", "e"))).alias("__nf_parts"))
    return spans.withColumnsRenamed({"rid": _RID, "th": _TH})


def _pairs(offsets: Column) -> Column:
    n = F.floor(F.size(offsets) / 2).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.struct(F.element_at(offsets, 2 * i - 1).alias("first"), F.element_at(offsets, 2 * i).alias("last")))


def removed(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes that stay, and how many maximal runs went."""
    kept, at, runs, end = [], 0, 0, -1
    for b, e in spans:
        if b > end:
            runs += 1
            kept.append(text[at:b])
        end = max(end, e)
        at = max(at, e)
    kept.append(text[at:])
    return b"".join(kept), runs


def _cut(batch: pa.RecordBatch, column: str = SPANS) -> Iterator[tuple[bytes, bytes, int]]:
    for text, spans in zip(batch.column("text"), batch.column(column).to_pylist(), strict=True):
        raw = b"" if not text.is_valid else text.as_buffer().to_pybytes()
        yield raw, *removed(raw, [(s["b"], s["e"]) for s in spans])


def _texts(batch: pa.RecordBatch, column: str = SPANS) -> pa.Array:
    valid = batch.column("text").is_valid().to_pylist()
    return pa.array([k.decode("utf-8", "ignore") if ok else None for (_, k, _), ok in zip(_cut(batch, column), valid, strict=True)], pa.string())


def removal_report(docs: DataFrame, length: int = 400, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row.

    With ``passage``, also text: what ``remove_repeats`` leaves at that length, as
    repeated passages may be shorter than ``length``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            made = list(_cut(batch))
            more = [_texts(batch, f"{SPANS}_1")] if passage else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in ([len(r) for r, _, _ in made], [len(r) - len(k) for r, k, _ in made], [n for _, _, n in made])), pa.array([hashlib.sha256(k).hexdigest() for _, k, _ in made]), *more],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if passage else [])],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    lengths = [length, passage] if passage else [length]
    return small_arrow(with_spans(rows, *lengths)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if passage else ""))


def remove_repeats(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` without the repeated bytes.  Where a run begins or ends within a
    character, the rest of that character goes too; null texts stay null."""
    fields = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([_texts(batch) if x == "text" else batch.column(x) for x in fields], fields)

    rows = docs.withColumn("text", docs["text"].cast("string"))
    return small_arrow(with_spans(rows, length)).mapInArrow(run, rows.schema)
