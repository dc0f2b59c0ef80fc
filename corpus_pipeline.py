"""The corpus pipeline: five stages over ``documents``, each one operator at work.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as
Parquet and read again as the next one's ``docs``.  All but the last give the
columns of ``documents``; ``n_chars`` follows a changed text.

1. toxicity: documents that the classifier scores 0.5 or more go.
2. near_dedup: one document of each group of near copies stays (five words, 80 %).
3. suffix_dedup: text that repeats over ``REPEAT`` bytes or more goes; documents stay.
4. decontaminate: documents that are contaminated go; in others, matched words go.
5. sentencepiece: ids and scores of the best segmentation, and round_trip: whether decoding
   the ids gives the stage's input text, byte for byte (a null text counts as empty).

Nulls, empty texts and repeated rows: see each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, near_dedup, sentencepieces, suffix_dedup, toxicity
from nearfield.llm.common import read_table, stage
from nearfield.llm.queries import vocabulary

#: Passages of over 50 words that repeat have at least about this many bytes.
REPEAT = 200


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out="__toxic")
    return scored.where("__toxic < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, words=5, percent=80).select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(suffix_dedup.remove_repeats(docs, REPEAT)).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    handles = decontaminate.broadcast_items(read_table(spark, sf_dir, "benchmark"))
    return _sized(decontaminate.clean(docs, handles)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    made = sentencepieces.encode(docs, path, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "score", "second_score", same.alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", drop_repeats), ("decontaminate", drop_benchmark), ("sentencepiece", encode)]

#: SQL has no way to say the classifier's or the tokenizer's stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
