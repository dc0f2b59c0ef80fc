"""Suffix-array deduplication against looking every window up."""

import hashlib
import random

import pytest

from nearfield.llm import suffix_dedup
from nearfield.llm.suffix_sort import deep_shallow
from tests.llm.brute import repeats


def lcp(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_deep_shallow_sorts_with_common_prefixes():
    r = random.Random(5)
    for _ in range(150):
        base = bytes(r.choice(b"ab\0") for _ in range(120))
        strings = []
        for _ in range(r.randint(0, 40)):
            cut = r.randint(0, 120)
            strings.append(base[:cut] + bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 30))))
        order, shared = deep_shallow(strings, r.choice([8, 16, 48]))
        made = [strings[i] for i in order]
        assert made == sorted(strings)
        assert shared.tolist() == ([0] + [lcp(a, b) for a, b in zip(made, made[1:])] if made else [])


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    passages = [text(60), text(90), text(41), text(200)]
    rows = [None, "", "short", "é" * 300, "aaaa" * 100]
    for _ in range(60):
        parts = [text(r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.randint(0, 20)
            parts += [p[cut : len(p) - r.randint(0, 20)], text(r.randint(0, 30))]
        rows.append("".join(parts))
    return rows + rows[5:12]


@pytest.mark.parametrize(("seed", "hot"), [(1, 256), (2, 1), (3, 3)])
def test_removal_is_exact(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    made = {r.doc_id: r for r in suffix_dedup.removal_report(docs, 40).collect()}
    for i, expected in enumerate(repeats(rows, 40)):
        assert (made[i].n_bytes, made[i].n_removed, made[i].n_spans, made[i].kept_sha256) == expected


@pytest.mark.parametrize("seed", [4, 5])
def test_a_longer_length_is_exact_though_sought_in_some_texts_only(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    made = {r.doc_id: r for r in suffix_dedup.removal_report(docs, 60, passage=40).collect()}
    runs = {r.doc_id: r for r in suffix_dedup.with_spans(docs, 60, 40).collect()}
    for i, (long, short) in enumerate(zip(repeats(rows, 60), repeats(rows, 40), strict=True)):
        assert (made[i].n_bytes, made[i].n_removed, made[i].n_spans, made[i].kept_sha256) == long
        raw = (rows[i] or "").encode()
        kept, n = suffix_dedup.removed(raw, [(s.b, s.e) for s in runs[i][f"{suffix_dedup.SPANS}_1"]])
        assert (len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()) == short[1:]


def test_null_ids_extra_columns_and_empty_tables(spark):
    text = "abcdefghijklmnopqrstuvwxyz" * 4
    rows = [(None, text, 1, "x"), (1, text, 2, "y"), (1, "other words", 3, None), (2, None, 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, rid string")
    made = suffix_dedup.remove_repeats(docs, 40)
    assert sorted((r.text, r.rid) for r in made.collect() if r.text) == [("other words", None)]
    assert suffix_dedup.removal_report(docs.limit(0), 40).count() == 0


def test_passages_shorter_than_the_length_are_taken_from_the_text(spark):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    short, long = some(52), some(90)  # 311 and 539 bytes
    rows = [(0, f"{some(40)} {short} {some(30)}"), (1, f"{some(25)} {short}"), (2, f"{some(10)} {long} {some(10)}"), (3, f"{long} {some(44)}"), (4, some(200)), (5, None), (5, ""), (None, some(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {(n, h) for n, _, _, h in repeats([t for _, t in rows], 400)}
    made = suffix_dedup.removal_report(docs, 400, passage=200).collect()
    assert {(x.n_bytes, x.kept_sha256) for x in made} == plain
    by_id = {x.doc_id: x for x in made if x.doc_id is not None and x.doc_id != 5}
    assert by_id[0].n_removed == by_id[1].n_removed == 0 and by_id[2].n_removed >= len(long) and by_id[3].n_removed >= len(long)
    for i in range(5):
        kept = repeats([t for _, t in rows], 200)[i][3]
        assert hashlib.sha256(by_id[i].text.encode()).hexdigest() == kept
    assert short not in by_id[0].text and short not in by_id[1].text and by_id[4].text == rows[4][1]
    assert sorted(x.text is None for x in made if x.doc_id == 5) == [False, True]
