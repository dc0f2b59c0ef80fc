"""Exact vector search over DataFrames: top-k, joins, matches and range search.

Ties are broken by the id, nulls come last, and a null or wrongly sized vector
never matches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import DISTANCES, SIMILARITIES, metric_name
from nearfield.kernels.metrics import pairwise

#: Bytes of query vectors that one broadcast holds; more queries go in further blocks.
QUERY_BLOCK = 32 << 20


def distance(column: str | Column, query: Sequence[float] | Column, metric: str = "l2sq") -> Column:
    return DISTANCES[metric_name(metric)](column, query)


def knn(df: DataFrame, query: Sequence[float], k: int, *, column: str = "embedding", key: str = "vec_id", metric: str = "l2sq", where: Column | str | None = None, offset: int = 0, out: str = "distance") -> DataFrame:
    """The k nearest rows after ``offset``; ``where`` is applied before the search."""
    if where is not None:
        df = df.where(where)
    d = distance(column, [float(x) for x in query], metric)
    near = df.withColumn(out, d).where(F.col(out).isNotNull()).orderBy(F.col(out).asc_nulls_last(), F.col(key)).limit(max(0, k) + offset)
    return near.offset(offset) if offset else near


def min_by_k(df: DataFrame, value: str, query: Sequence[float], k: int, *, column: str = "embedding", key: str = "vec_id", metric: str = "l2sq") -> DataFrame:
    """One row with ``matches``: ``value`` of the k nearest rows, nearest first."""
    near = knn(df, query, k, column=column, key=key, metric=metric)
    rows = F.array_sort(F.collect_list(F.struct(F.col("distance").alias("d"), F.col(key).alias("i"), F.col(value).alias("v"))))
    return near.agg(F.transform(rows, lambda x: x.v).alias("matches"))


def within(df: DataFrame, query: Sequence[float], radius: float, *, column: str = "embedding", metric: str = "l2sq") -> DataFrame:
    """Every row at a distance of at most ``radius``."""
    return df.withColumn("distance", distance(column, [float(x) for x in query], metric)).where(F.col("distance") <= radius)


def query_blocks(queries: DataFrame, column: str, key: str) -> Iterator[tuple[list, np.ndarray]]:
    """The query table as (ids, matrix) blocks of at most QUERY_BLOCK bytes."""
    known = queries.where(F.col(column).isNotNull()).select(F.col(key).alias("q"), F.col(column).cast("array<double>").alias("v"))
    size = known.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size.n:
        return
    blocks = max(1, -(-size.n * size.d * 8 // QUERY_BLOCK))
    for b in range(blocks):
        rows = (known if blocks == 1 else known.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).collect()
        if rows:
            yield [r.q for r in rows], np.array([r.v for r in rows], np.float64)


def nearest_in_batches(batches: Iterator[pd.DataFrame], ids: list, matrix: np.ndarray, k: int, metric: str) -> Iterator[pd.DataFrame]:
    """The k nearest rows (key, vec) of a partition for each query."""
    best_d = np.full((len(ids), 0), np.inf)
    best_i = np.zeros((len(ids), 0), np.int64)
    for batch in batches:
        batch = batch[[v is not None and len(v) == matrix.shape[1] for v in batch["vec"]]]
        if not len(batch):
            continue
        d = pairwise(matrix, np.stack(batch["vec"].to_numpy()).astype(np.float64), metric)
        if metric == "l2sq":
            d = np.sqrt(d)
        d = np.concatenate([best_d, d], axis=1)
        i = np.concatenate([best_i, np.broadcast_to(batch["key"].to_numpy(np.int64), (len(ids), len(batch)))], axis=1)
        order = np.lexsort((i, d), axis=1)[:, :k]
        best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
    n = best_d.shape[1]
    if n:
        yield pd.DataFrame({"q": np.repeat(np.array(ids), n), "key": best_i.ravel(), "distance": best_d.ravel()})


def knn_join(queries: DataFrame, items: DataFrame, k: int, *, query_column: str = "embedding", query_key: str = "vec_id", column: str = "embedding", key: str = "vec_id", metric: str = "l2sq", outer: bool = False) -> DataFrame:
    """query_id, key, distance, rank for the k nearest items of each query.

    A query without a vector has no row, or with ``outer`` one row of nulls.  Query blocks of a checked size are broadcast; each partition of the items
    keeps its k nearest to each query, and only those are shuffled.
    """
    name = metric_name(metric)
    rows = items.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("vec")).where("vec is not null")
    kind = queries.schema[query_key].dataType.simpleString()
    schema = f"q {kind}, key long, distance double"
    found = items.sparkSession.createDataFrame([], schema)
    if k > 0:
        for ids, matrix in query_blocks(queries, query_column, query_key):
            handle = items.sparkSession.sparkContext.broadcast((ids, matrix))
            found = found.unionAll(rows.mapInPandas(lambda batches, handle=handle: nearest_in_batches(batches, *handle.value, k, name), schema))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("distance").asc_nulls_last(), "key"))
    made = found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "key", "distance", "rank")
    return queries.select(F.col(query_key).alias("query_id")).distinct().join(made, "query_id", "left") if outer else made


def _score(metric: str, left: Column, right: Column) -> tuple[Column, bool]:
    """The score and whether smaller is better: a distance for l2, else a similarity."""
    name = metric_name(metric)
    return (DISTANCES[name](left, right), True) if name == "l2sq" else (SIMILARITIES[name](left, right), False)


def vector_join(left: DataFrame, right: DataFrame, left_column: str, right_column: str, k: int, metric: str = "l2sq", *, left_key: str, right_key: str) -> DataFrame:
    """score, left_tbl, right_tbl for the k best right rows of each left row.

    Rows count by themselves on both sides: a key may be repeated, with equal or other
    vectors.  A left row with a null vector has no match.
    """
    name = metric_name(metric)
    rows = left.where(F.col(left_column).isNotNull()).select(F.xxhash64(F.col(left_column).cast("array<double>")).alias("q"), F.col(left_column).alias("w"), F.struct("*").alias("left_tbl"))
    vectors = rows.select("q", "w").dropDuplicates(["q"])
    near = knn_join(vectors, right, k, query_column="w", query_key="q", column=right_column, key=right_key, metric=name)
    # the k nearest rows are among those of the keys found; a key may have several rows, with other vectors too
    found = near.select(F.col("query_id").alias("q"), "key").distinct().join(vectors, "q")
    found = found.join(right.select(F.col(right_key).cast("long").alias("key"), F.col(right_column).alias("v"), F.struct("*").alias("right_tbl")), "key")
    found = found.withColumn("d", DISTANCES[name](F.col("w"), F.col("v"))).where("d is not null")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "key", F.xxhash64("v"), F.xxhash64("right_tbl")))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    score, _ = _score(name, F.col("w"), F.col("v"))
    return found.select("q", score.alias("score"), "right_tbl").join(rows.select("q", "left_tbl"), "q").select("score", "left_tbl", "right_tbl")


def vector_match(right: DataFrame, query: Sequence[float], right_column: str, k: int, metric: str = "l2sq", *, right_key: str) -> DataFrame:
    """One row with ``matches``: array of {score, row}, best first."""
    name = metric_name(metric)
    score, ascending = _score(name, F.col(right_column), [float(x) for x in query])
    near = knn(right, query, k, column=right_column, key=right_key, metric=name)
    near = near.select(score.alias("score"), F.struct(*right.columns).alias("row"), F.col(right_key).alias("i"))
    order = F.col("score") if ascending else -F.col("score")
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("i"), F.col("score"), F.col("row"))))
    return near.agg(F.transform(rows, lambda x: F.struct(x.score.alias("score"), x.row.alias("row"))).alias("matches"))
