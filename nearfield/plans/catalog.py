"""Which index serves a search: the first registered one of the table, column and metric."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import metric_name
from nearfield.operators import knn, knn_join
from nearfield.plans.index import VectorIndex
from nearfield.plans.rewrite import Nearest, nearest, written_out


class Catalog:
    """Named indexes of named tables."""

    def __init__(self) -> None:
        self._indexes: dict[str, tuple[str, VectorIndex]] = {}

    def register(self, name: str, table: str, index: VectorIndex) -> None:
        if name in self._indexes:
            raise ValueError(f"index {name!r} exists")
        self._indexes[name] = (table, index)

    def get(self, name: str) -> VectorIndex:
        if name not in self._indexes:
            raise KeyError(f"no index named {name!r}")
        return self._indexes[name][1]

    def drop(self, name: str) -> None:
        self.get(name).drop()
        del self._indexes[name]

    def check_drop_column(self, table: str, column: str) -> None:
        """Raise if an index needs the column."""
        for name, (t, index) in self._indexes.items():
            if t == table and index.column == column:
                raise ValueError(f"column {column!r} of {table!r} is used by index {name!r}")

    def find(self, table: str, column: str, metric: str, dim: int) -> VectorIndex | None:
        for t, index in self._indexes.values():
            if (t, index.column, index.options.metric, index.dim) == (table, column, metric_name(metric), dim):
                return index
        return None

    def top_k(self, table: str, df: DataFrame, query: Sequence[float], k: int, *, column: str = "embedding", key: str = "vec_id", metric: str = "l2sq", ascending: bool = True, **how: object) -> DataFrame:
        """By an index if one fits (ascending order only), else exactly."""
        index = self.find(table, column, metric, len(query)) if ascending else None
        if index is not None:
            return index.search(query, k, **how)
        if ascending:
            return knn(df, query, k, column=column, key=key, metric=metric)
        from nearfield.operators import distance

        far = df.withColumn("distance", distance(column, [float(x) for x in query], metric))
        return far.orderBy(F.col("distance").desc_nulls_last(), key).limit(k)

    def _asked(self, spark: SparkSession, text: str) -> tuple[Nearest, VectorIndex] | None:
        asked = nearest(spark, text)
        if asked is None:
            return None
        index = self.find(asked.table, asked.column, asked.metric, len(asked.query))
        return None if index is None else (asked, index)

    def index_for(self, spark: SparkSession, text: str) -> str | None:
        """The name of the index that ``sql`` would answer ``text`` by."""
        found = self._asked(spark, text)
        return found and next(name for name, (_, index) in self._indexes.items() if index is found[1])

    def sql(self, spark: SparkSession, text: str, *, rerank: int | None = None, effort: int | None = None) -> DataFrame:
        """The rows of an SQL query; by an index where it asks for the nearest rows of
        a table that has a fitting one (see ``nearest``), else by Spark alone.

        With an index the query itself runs over the candidate rows only, so its
        select list, order, limit and offset mean what they always mean.  Its filter
        restricts the candidates too.  Rows without a vector are never candidates.
        The distances of ``nearfield.functions.register`` may stand in ORDER BY.
        """
        found = self._asked(spark, text)
        text = written_out(spark, text)
        if found is None:
            return spark.sql(text)
        asked, index = found
        table = spark.table(asked.table)
        allowed = None if asked.where is None else table.alias(asked.name).where(asked.where)
        near = index.near_ids(asked.query, asked.limit, rerank=rerank, effort=effort, allowed=allowed)
        rows = table.join(near, table[index.key] == near["__nf_near"], "left_semi")
        view = f"nearfield_{uuid.uuid4().hex}"
        rows.createTempView(view)
        try:
            return spark.sql(f"WITH `{asked.table}` AS (SELECT * FROM {view}) {text}")
        finally:
            spark.catalog.dropTempView(view)

    def join(self, table: str, queries: DataFrame, items: DataFrame, k: int, *, column: str = "embedding", key: str = "vec_id", metric: str = "l2sq", **how: object) -> DataFrame:
        dims = items.selectExpr(f"size({column}) AS n").where("n > 0").limit(1).collect()
        index = self.find(table, column, metric, dims[0].n) if dims else None
        if index is not None:
            return index.knn_join(queries, k, **how)
        return knn_join(queries, items, k, column=column, key=key, metric=metric, **how)
