"""Nulls, odd texts, repeated ids, hot groups and empty tables; blocks of any size give the same result."""

import random

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from nearfield.llm import decontaminate, fingerprints, near_dedup, sentencepieces, token_files
from nearfield.llm.common import only_wanted, stage
from nearfield.llm.kernels import texts_of
from tests.llm.brute import near_components
from tests.llm.test_operators import prose

ODD = ["a", "B", "'s", "'S", "'", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|>", "é", "É", "é", "́", "=", "̸", "7", "٣", "½", " ", "\n", "\t", " ", "　", "中文", "ß", "İ", "Σ", "ﬁ", "😀", "‍", "\x00", "\x1c", "-", "--", ",", "don't", "WE'LL", "x86", "the", "ing"]


def odd_texts(n, seed=3, longest=9):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_tokens_are_the_library_s_on_odd_texts():
    texts = odd_texts(4000)
    made, count = token_files.Encoder(path("word_bpe_49k.json")).encode_all(texts_of(pa.array(texts)))
    until = np.concatenate([[0], np.cumsum(count)])
    expected = Tokenizer.from_file(path("word_bpe_49k.json")).encode_batch(texts, add_special_tokens=False)
    assert [made[a:b].tolist() for a, b in zip(until, until[1:])] == [x.ids for x in expected]


def test_other_tokenizer_files_take_the_whole_library():
    texts = odd_texts(300)
    encode = token_files.Encoder(path("byte_bpe_50k.json"))
    made, count = encode.encode_all(texts_of(pa.array(texts)))
    until = np.concatenate([[0], np.cumsum(count)])
    assert not encode.cut
    assert [made[a:b].tolist() for a, b in zip(until, until[1:])] == [x.ids for x in Tokenizer.from_file(path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]


def test_the_array_search_equals_the_search_of_whole_texts():
    model = sentencepieces.Pieces(path("piece_bpe_32k.model"), 3)
    texts = [*odd_texts(60, 5), "", "=" * 700, "ab" * 300 + " " + "-" * 20, "x" * 3000]
    whole = model.encode_all(texts)
    for text, found in zip(texts, whole):
        if not text:
            assert [(s, x.tolist()) for s, x in found] == [(0.0, [])]
            continue
        unit = f" {text}".replace(" ", sentencepieces.SPACE)
        expected = model.unit(unit, 3)  # one lattice over the text, no cuts
        assert [s for s, _ in found] == [s for s, _ in expected]
        assert len({x.tobytes() for _, x in found}) == len(found)
        assert [(s, x.tolist()) for s, x in model.encode(text)] == [(s, x.tolist()) for s, x in found]
        assert all(model.decode(x) == text for _, x in found)


def test_items_in_many_blocks_give_the_same_hits(spark, monkeypatch):
    r = random.Random(6)
    items = [(i, prose(r, r.randint(5, 30))) for i in range(20)] + [(99, None), (98, "")]
    rows = [(i, f"{prose(r, 20)} {items[i % 20][1]} {prose(r, 10)}") for i in range(30)] + [(None, items[0][1]), (40, None), (41, "")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = stage(decontaminate.build_index(docs), "index")
    key = lambda rows: sorted(map(str, rows))
    one = key(decontaminate.contamination(index, decontaminate.broadcast_items(items)).collect())
    cleaned = key(decontaminate.clean(docs, decontaminate.broadcast_items(items)).collect())
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 512)
    handles = decontaminate.broadcast_items(items)
    assert len(handles) > 3
    assert key(decontaminate.contamination(index, handles).collect()) == one
    assert key(decontaminate.clean(docs, handles).collect()) == cleaned


def test_wanted_rows_pass_and_most_others_do_not(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "key")
    made = only_wanted(rows, "key", spark.range(0, 20_000, 100).select(F.col("id").alias("other")))
    found = {r.key for r in made.collect()}
    assert found >= set(range(0, 20_000, 100)) and len(found) < 400
    assert only_wanted(rows, "key", spark.range(0)).count() == 0


def test_near_copies_with_null_and_repeated_ids_and_a_loose_cluster(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 3)
    monkeypatch.setattr(near_dedup, "ROWS", 4)
    r = random.Random(9)
    rows, words = [], prose(r, 60).split()
    for i in range(40):  # each text differs from the one before in one word: far ends aren't alike
        words[r.randrange(60)] = prose(r, 1)
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, rows[0][1]) for i in range(30)]
    expected = near_components(rows, 3, 85)
    odd = [(None, rows[0][1]), (None, None), (300, ""), (301, None), (302, " \n")]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string")
    made = near_dedup.near_duplicates(docs, 3, 85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in made if x.doc_id is not None and x.doc_id < 300} == expected
    assert all(x.component_id == x.doc_id and x.kept and not x.n_shingles for x in made if x.doc_id is not None and x.doc_id >= 300)
    assert [(x.component_id, x.kept) for x in made if x.doc_id is None] == [(None, True)] * 2
    again = spark.createDataFrame([(7, prose(r, 30)), (7, rows[0][1]), (7, rows[0][1]), (5, rows[0][1])], "doc_id long, text string")
    assert sorted(x.component_id for x in near_dedup.near_duplicates(again, 3, 85).collect())[0] == 5


def test_successors_of_repeated_ids(spark):
    rows = [(1, "a b c"), (1, "d e f"), (1, "a b c"), (None, "g h i"), (None, None), (2, ""), (0, "x" * 40_000)]
    made = fingerprints.edit_report(spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(5)).collect()
    assert len(made) == 21 and sorted(x.n_chars for x in made) == sorted(len(t or "") for _, t in rows * 3)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_rows(spark, tmp_path, empty):
    r = random.Random(10)
    shared = prose(r, 45)
    texts = [None, "", " ", prose(r, 40), "w" * 30_000, f"{prose(r, 30)} {shared}", f"{shared} {prose(r, 30)}", prose(r, 50)]
    rows = [(i, t, "en", "s", len(t or ""), "kept") for i, t in enumerate([*texts, texts[3], texts[3]])] + [(None, prose(r, 30), None, None, None, None), (3, prose(r, 35), "en", "s", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame([] if empty else rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([] if empty else [(i, 0, int(i == 0)) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([] if empty else [(0, texts[7]), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [x.doc_id for x in made]
    if empty:
        assert not made
        return
    assert 7 not in ids and 8 not in ids and 9 not in ids  # the benchmark's own text, and copies
    assert ids.count(3) == 2 and ids.count(None) == 1 and {0, 1, 2, 4, 5, 6} <= set(ids)
    assert all(x.round_trip for x in made) and all(x.n_tokens == len(x.ids) for x in made)
    sizes = {x.doc_id: x.n_tokens for x in made}
    assert sizes[0] == sizes[1] == 0 and sizes[5] < 200 and sizes[6] < 200
