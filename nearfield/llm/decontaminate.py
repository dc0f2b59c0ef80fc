"""Benchmark decontamination (operator 5): a positional inverted index.

``build_index`` cuts each partition of the documents into blocks of a few MB
and stores, for each block, one row: its documents' first word positions, the
sorted hashes of its distinct words, and for each word the ascending positions
at which it stands (delta coded).  The blocks are independent, so the index is
built and searched without a shuffle, and no word's postings, however frequent
the word, are gathered in one place.

A search takes a phrase's positions of its rarest word, shifted by the word's
place in the phrase, and intersects them with the shifted lists of the other
words, rarest first.  ``phrase_matches`` gives every occurrence, ``near_matches``
every smallest stretch of at most ``span`` words that holds all given words.

Test items are sent to the executors in blocks of at most ``ITEM_BLOCK`` bytes;
each block is broadcast on its own, and a task holds one at a time.

Defined results: null text has no words; rows are reported one by one, also if
their doc_id repeats or is null; items of one text count each; an item without
a word, or without a text, never occurs; repeated item_ids count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import small_arrow
from nearfield.llm.kernels import ALNUM, lower, small_batches, texts_of, word_hashes, words_of

WINDOW = 13
BLOCK = 8 << 20
ITEM_BLOCK = 32 << 20
INDEX = "doc_ids binary, is_null binary, first_word binary, terms binary, counts binary, postings binary"


def _index_block(batch: pa.RecordBatch, key: str, text: str) -> pa.RecordBatch:
    low = lower(texts_of(batch.column(text)))
    words = words_of(low, ALNUM)
    h = word_hashes(low.buf, words)
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    first = np.flatnonzero(np.diff(sorted_h, prepend=~sorted_h[:1])) if len(h) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(h))).astype(np.uint32)
    delta = np.diff(order, prepend=0)
    delta[first] = order[first]
    ids = batch.column(key)
    doc_ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    bounds = np.append(words.first, words.last[-1:]).astype("<i8")
    blobs = [doc_ids, np.asarray(ids.is_null()).astype(np.uint8), bounds, sorted_h[first].astype("<u8"), counts, delta.astype("<u4")]
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], [x.split()[0] for x in INDEX.split(", ")])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents; write it with ``stage`` or to any path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in small_batches(batches, text, BLOCK):
            texts = texts_of(batch.column(text))
            more = int((texts.end - texts.start).sum())
            if held and size + more > BLOCK:
                yield _index_block(_joined(held), key, text)
                held, size = [], 0
            held.append(batch)
            size += more
        if held:
            yield _index_block(_joined(held), key, text)

    return small_arrow(docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))).mapInArrow(run, INDEX)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


class Block:
    """One row of the index, opened."""

    def __init__(self, row: dict) -> None:
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.is_null = np.frombuffer(row["is_null"], np.uint8).astype(bool)
        self.first_word = np.frombuffer(row["first_word"], "<i8")
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])
        self.delta = np.frombuffer(row["postings"], "<u4")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word among the terms, -1 where it doesn't occur."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def positions(self, term: int) -> np.ndarray:
        return np.cumsum(self.delta[self.begin[term] : self.begin[term + 1]], dtype=np.int64)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first_word, position, "right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """First positions of every occurrence of consecutive terms within a document."""
        order = np.argsort(self.counts[terms], kind="stable")
        start = self.positions(terms[order[0]]) - order[0]
        for j in order[1:]:
            if not len(start):
                return start
            there = self.positions(terms[j])
            at = np.minimum(np.searchsorted(there, start + j), len(there) - 1)
            start = start[there[at] == start + j]
        start = start[start >= 0]
        return start[self.doc_of(start) == self.doc_of(start + len(terms) - 1)]

    def near(self, terms: np.ndarray, span: int) -> list[tuple[int, int]]:
        """(first, last) of every stretch of at most ``span`` words that starts and
        ends with one of the terms, holds all of them, and no smaller such stretch."""
        terms = np.unique(terms)
        lists = [self.positions(t) for t in terms]
        where = np.concatenate(lists)
        which = np.repeat(np.arange(len(terms)), [len(x) for x in lists])
        order = np.argsort(where, kind="stable")
        where, which = where[order], which[order]
        doc = self.doc_of(where)
        last_seen, found = np.full(len(terms), -1), []
        for i in range(len(where)):
            last_seen[which[i]] = i
            begin = int(last_seen.min())
            if begin < 0 or doc[begin] != doc[i] or where[i] - where[begin] >= span:
                continue
            if found and found[-1][0] == where[begin]:
                continue  # the earlier end is nearer
            found.append((int(where[begin]), int(where[i])))
        return found


def item_words(texts: list[str]) -> list[np.ndarray]:
    """The word hashes of each text."""
    low = lower(texts_of(pa.array(texts, pa.large_string())))
    words = words_of(low, ALNUM)
    h = word_hashes(low.buf, words)
    return [h[a:b] for a, b in zip(words.first.tolist(), words.last.tolist(), strict=True)]


def broadcast_items(items: DataFrame, key: str = "item_id", text: str = "text") -> list:
    """Broadcasts of (ids as strings, word hashes), each of a checked size."""
    spark = items.sparkSession
    known = items.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    total = known.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // ITEM_BLOCK))
    out = []
    for b in range(blocks):
        rows = (known if blocks == 1 else known.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)).collect()
        out.append(spark.sparkContext.broadcast(([r.id for r in rows], item_words([r.text for r in rows]))))
    return out


def search_items(block: Block, ids: list[str], hashes: list[np.ndarray], window: int = WINDOW) -> Iterator[tuple[str, int, np.ndarray]]:
    """(item, words in the window, first positions) for each window that occurs."""
    if not hashes:
        return
    lengths = np.array([len(x) for x in hashes])
    places = block.find(np.concatenate(hashes) if lengths.sum() else np.zeros(0, np.uint64))
    begin = np.concatenate([[0], np.cumsum(lengths)])
    for i, n in enumerate(lengths.tolist()):
        size = min(window, n)
        if not n:
            continue
        terms = places[begin[i] : begin[i + 1]]
        missing = np.concatenate([[0], np.cumsum(terms < 0)])
        for j in np.flatnonzero(missing[size:] == missing[:-size]).tolist():
            starts = block.phrase(terms[j : j + size])
            if len(starts):
                yield ids[i], size, starts


def _hits(block: Block, handles: list) -> tuple[np.ndarray, list[set[str]]]:
    """For each word whether it is hit, for each document its items."""
    total = int(block.first_word[-1]) if len(block.first_word) else 0
    edge = np.zeros(total + 1, np.int32)
    items: list[set[str]] = [set() for _ in block.doc_ids]
    for handle in handles:
        ids, hashes = handle.value
        for item, size, starts in search_items(block, ids, hashes):
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + size, -1)
            for d in np.unique(block.doc_of(starts)).tolist():
                items[d].add(item)
        if len(handles) > 1:
            vars(handle).pop("_value", None)  # this process's copy; the task reads it again for its next block
    return np.cumsum(edge[:-1]) > 0, items


def contamination(index: DataFrame, handles: list) -> DataFrame:
    """One row for each indexed document, by the rule of 20 hit words to n words."""
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                hit, items = _hits(block, handles)
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_words, n_hit = np.diff(block.first_word), np.diff(sums[block.first_word])
                digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.doc_ids, pa.int64(), mask=block.is_null), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                        pa.array(digest, pa.string()), pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return small_arrow(index).mapInArrow(run, schema)


def phrase_matches(index: DataFrame, handles: list, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, word (place in the document), n_words: every occurrence of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for handle in handles:
                    for item, size, starts in search_items(block, *handle.value, window):
                        doc = block.doc_of(starts)
                        yield _matches(block, doc, item, starts - block.first_word[doc], np.full(len(doc), size))

    return small_arrow(index).mapInArrow(run, "doc_id long, item_id string, word long, n_words long")


def near_matches(index: DataFrame, handles: list, span: int) -> DataFrame:
    """doc_id, item_id, word, n_words: every smallest stretch of at most ``span`` words with all of an item's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for handle in handles:
                    for item, hashes in zip(*handle.value, strict=True):
                        terms = block.find(hashes)
                        if not len(terms) or (terms < 0).any():
                            continue
                        found = np.array(block.near(terms, span), np.int64).reshape(-1, 2)
                        doc = block.doc_of(found[:, 0])
                        yield _matches(block, doc, item, found[:, 0] - block.first_word[doc], found[:, 1] - found[:, 0] + 1)

    return small_arrow(index).mapInArrow(run, "doc_id long, item_id string, word long, n_words long")


def _matches(block: Block, doc: np.ndarray, item: str, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    ids = pa.array(block.doc_ids[doc], pa.int64(), mask=block.is_null[doc])
    return pa.RecordBatch.from_arrays([ids, pa.array([item] * len(doc), pa.string()), pa.array(word.astype(np.int64)), pa.array(n.astype(np.int64))], ["doc_id", "item_id", "word", "n_words"])


def clean(docs: DataFrame, handles: list) -> DataFrame:
    """``docs`` without the contaminated rows; of other rows with hit words, each
    run of them (from the first word's first byte to the last one's last) goes.

    The index of a block of rows is built, searched and dropped in one task.
    """
    fields = docs.columns
    rows = docs.withColumn("text", docs["text"].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BLOCK):
            keyed = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], ["id", "text"])
            block = Block({k: v[0] for k, v in _index_block(keyed, "id", "text").to_pydict().items()})
            hit, _ = _hits(block, handles)
            sums = np.concatenate([[0], np.cumsum(hit)])
            n_words, n_hit = np.diff(block.first_word), np.diff(sums[block.first_word])
            kept = ~((n_hit > 0) & (20 * n_hit >= n_words))
            changed = {}
            if (kept & (n_hit > 0)).any():
                texts = texts_of(batch.column("text"))
                words = words_of(lower(texts), ALNUM)
                for i in np.flatnonzero(kept & (n_hit > 0)).tolist():
                    raw, base = texts.of(i), int(texts.start[i])
                    mine = np.flatnonzero(hit[words.first[i] : words.last[i]]) + words.first[i]
                    ends = np.flatnonzero(np.diff(mine, append=-1) != 1)
                    begins = np.concatenate([[0], ends[:-1] + 1])
                    at, parts = 0, []
                    for a, b in zip(mine[begins].tolist(), mine[ends].tolist(), strict=True):
                        parts.append(raw[at : int(words.start[a]) - base])
                        at = int(words.end[b]) - base
                    changed[i] = b"".join([*parts, raw[at:]]).decode()
            columns = [batch.column(x) for x in fields]
            if changed:
                column = batch.column("text").to_pylist()
                for i, text in changed.items():
                    column[i] = text
                columns[fields.index("text")] = pa.array(column, pa.string())
            yield pa.RecordBatch.from_arrays(columns, fields).filter(pa.array(kept))

    return small_arrow(rows).mapInArrow(run, rows.schema)
