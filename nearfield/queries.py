"""The registered queries over ``embeddings`` and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield import functions, operators
from nearfield.plans.index import VectorIndex

Query = Callable[[SparkSession, str], DataFrame]
K = 10
_METRICS = {"l2": "l2sq", "cosine": "cosine", "ip": "ip"}


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _scaled(df: DataFrame) -> DataFrame:
    """Vectors of different lengths, so that the metrics rank differently."""
    return df.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("label"))))


def _query(df: DataFrame, vec_id: int = 0) -> list[float]:
    return list(df.where(F.col("vec_id") == vec_id).select(F.col("embedding").cast("array<double>")).first()[0])


def _top(near: DataFrame) -> DataFrame:
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset; set it to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="nearfield-")
    return f"{shared.rstrip('/')}/indexes/{uuid.uuid4().hex}"


_SQL_DISTANCE = {
    "l2": "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))",
    "cosine": "(1 - list_cosine_similarity({a}, {b}))",
    "ip": "(-list_inner_product({a}, {b}))",
}
_SQL_SIMILARITY = {"l2": _SQL_DISTANCE["l2"], "cosine": "list_cosine_similarity({a}, {b})", "ip": "list_inner_product({a}, {b})"}
_PLAIN = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_SCALED = "e AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x * (1 + label)) AS v FROM embeddings)"


def _sql_distance(metric: str, a: str, b: str) -> str:
    return _SQL_DISTANCE[metric].format(a=a, b=b)


def _sql_top(metric: str, source: str = _PLAIN, where: str = "TRUE", k: int = K, offset: int = 0) -> str:
    d = _sql_distance(metric, "e.v", "q.v")
    return f"WITH {source}, q AS (SELECT v FROM e WHERE vec_id = 0) SELECT vec_id, round({d}, 6) AS distance FROM e, q WHERE {where} ORDER BY {d}, vec_id LIMIT {k} OFFSET {offset}"


def _sql_join(metric: str, k: int, where: str = "TRUE") -> str:
    d = _sql_distance(metric, "a.v", "b.v")
    return f"""WITH {_SCALED}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS key, {d} AS d FROM e a, e b WHERE a.vec_id % 100 = 0 AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, key) AS rank FROM p) SELECT query_id, key, round(d, 6) AS distance, rank FROM r WHERE rank <= {k}"""


def _topk(metric: str, scaled: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir)
        df = _scaled(df) if scaled else df
        return _top(operators.knn(df, _query(df), K, metric=metric))

    return run


def topk_filter_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir)
    return _top(operators.knn(df, _query(df), K, where="label = 3"))


def topk_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir)
    return _top(operators.knn(df, _query(df), K, offset=15))


def cosine_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered by ``1 - array_cosine_similarity`` in SQL."""
    functions.register(spark)
    df = _table(spark, sf_dir)
    df.createOrReplaceTempView("nearfield_e")
    q = ", ".join(f"{x!r}D" for x in _query(df))
    return spark.sql(
        f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, 1 - array_cosine_similarity(cast(embedding AS array<double>), array({q})) AS d FROM nearfield_e) ORDER BY d, vec_id LIMIT {K}"
    )


def min_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir)
    return operators.min_by_k(df, "vec_id", _query(df), K).select(F.explode("matches").alias("vec_id"))


def within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir)
    return _top(operators.within(df, _query(df), 1.2))


def match(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled(_table(spark, sf_dir))
    made = operators.vector_match(df, _query(df), "embedding", 5, "cosine", right_key="vec_id")
    return made.select(F.explode("matches").alias("m")).select(F.round("m.score", 6).alias("score"), F.col("m.row.vec_id").alias("vec_id"))


def _join(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _scaled(_table(spark, sf_dir))
        made = operators.vector_join(df.where("vec_id % 100 = 0"), df, "embedding", "embedding", 3, metric, left_key="vec_id", right_key="vec_id")
        return made.select(F.round("score", 6).alias("score"), F.col("left_tbl.vec_id").alias("left_id"), F.col("right_tbl.vec_id").alias("right_id"))

    return run


def _sql_vector_join(metric: str) -> str:
    d, s = _sql_distance(metric, "a.v", "b.v"), _SQL_SIMILARITY[metric].format(a="a.v", b="b.v")
    return f"""WITH {_SCALED}, p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, {s} AS s, {d} AS d FROM e a, e b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY d, right_id) AS n FROM p) SELECT round(s, 6) AS score, left_id, right_id FROM r WHERE n <= 3"""


def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled(_table(spark, sf_dir))
    return operators.knn_join(df.where("vec_id % 100 = 0"), df, K).withColumn("distance", F.round("distance", 6))


def knn_join_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels among each query row's neighbours."""
    df = _scaled(_table(spark, sf_dir))
    near = operators.knn_join(df.where("vec_id % 100 = 0"), df, K)
    return near.join(df.select(F.col("vec_id").alias("key"), "label"), "key").groupBy("query_id", "label").agg(F.count("*").alias("n"))


def _indexed(algorithm: str, **options: object) -> Query:
    """One vector's search of an index of the scaled vectors that probes every cell; a quantizer has to find the k nearest among its k * 10 best."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _scaled(_table(spark, sf_dir))
        index = VectorIndex.build(df, _folder(spark), algorithm, **options)
        return _top(index.search(_query(df), K, effort=options["nlist"], rerank=10 if options.get("quantizer", "flat") != "flat" else None))

    return run


def _index_join(algorithm: str, **options: object) -> Query:
    """All query rows' neighbours by an index of the scaled vectors, with settings that may miss some."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _scaled(_table(spark, sf_dir))
        index = VectorIndex.build(df, _folder(spark), algorithm, **options)
        return index.knn_join(df.where("vec_id % 100 = 0"), K).withColumn("distance", F.round("distance", 6))

    return run


#: The share of true neighbours that an index has to find.
GATE = 0.9


def _recall(algorithm: str, metric: str = "l2sq", **options: object) -> Query:
    """Whether an index finds ``GATE`` of the exact k nearest of all query rows, and how many of them there are."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _scaled(_table(spark, sf_dir))
        asked = df.where("vec_id % 100 = 0")
        index = VectorIndex.build(df, _folder(spark), algorithm, metric=metric, **options)
        found = index.knn_join(asked, K).select("query_id", "key", F.lit(1).alias("hit"))
        exact = operators.knn_join(asked, df, K, metric=metric).select("query_id", "key")
        made = exact.join(found, ["query_id", "key"], "left").agg(F.count("*").alias("neighbours"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))
        return made.select("neighbours", (F.col("recall") >= GATE).alias("enough"))

    return run


#: Settings below those that probe everything, one for each index type and quantizer.
_RECALLS = {
    "recall_hnsw": ("hnsw", {}),
    "recall_hnsw_rabitq": ("hnsw", {"quantizer": "rabitq", "bits": 3, "rerank": 10}),
    "recall_diskann_rabitq": ("diskann", {"quantizer": "rabitq", "bits": 4, "rerank": 10}),
    "recall_diskann_pq": ("diskann", {"quantizer": "pq", "rerank": 10}),
    "recall_ivf": ("ivf", {"nlist": 32, "nprobe": 8}),
    "recall_ivf_rabitq": ("ivf", {"nlist": 32, "nprobe": 8, "quantizer": "rabitq", "bits": 3, "rerank": 10}),
    "recall_ivf_cosine": ("ivf", {"nlist": 32, "nprobe": 24, "metric": "cosine", "normalize_cells": True}),
    "recall_spann": ("spann", {"nlist": 32, "nprobe": 8}),
    "recall_spann_scann": ("spann", {"nlist": 32, "nprobe": 8, "quantizer": "scann", "rerank": 10}),
}


def ivf_filter_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled(_table(spark, sf_dir))
    index = VectorIndex.build(df, _folder(spark), "ivf", nlist=16)
    return _top(index.search(_query(df), K, effort=16, where="label < 5", filter_mode="post"))


def ivf_filter_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled(_table(spark, sf_dir))
    index = VectorIndex.build(df, _folder(spark), "ivf", nlist=16)
    return _top(index.search(_query(df), K, effort=16, where="label = 3"))


def ivf_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled(_table(spark, sf_dir))
    index = VectorIndex.build(df, _folder(spark), "ivf", nlist=16)
    return index.knn_join(df.where("vec_id % 100 = 0"), K, effort=16).withColumn("distance", F.round("distance", 6))


def spann_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a row in several cells count once."""
    df = _scaled(_table(spark, sf_dir))
    index = VectorIndex.build(df, _folder(spark), "spann", nlist=16, replica_count=4, closure_factor=10.0)
    return index.knn_join(df.where("vec_id % 100 = 0"), K, effort=16).withColumn("distance", F.round("distance", 6))


def delete_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled(_table(spark, sf_dir))
    index = VectorIndex.build(df, _folder(spark), "ivf", nlist=16)
    index.delete(df.where("label = 3"))
    return _top(index.search(_query(df), K, effort=16))


def insert_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled(_table(spark, sf_dir))
    index = VectorIndex.build(df.where("label <> 3"), _folder(spark), "ivf", nlist=16)
    index.base = df
    index.insert(df.where("label = 3"))
    return _top(index.search(_query(df), K, effort=16))


def compact_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled(_table(spark, sf_dir))
    index = VectorIndex.build(df, _folder(spark), "ivf", nlist=16)
    index.delete(df.where("label = 3"))
    return _top(index.compact(_folder(spark)).search(_query(df), K, effort=16))


def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir)
    index = VectorIndex.build(df, _folder(spark), "spann", nlist=16, quantizer="rabitq", bits=3)
    return index.info().select("index_type", "metric", "quantizer", "dimensions", "code_size", "nlist", "count")


def queries() -> dict[str, Query]:
    made: dict[str, Query] = {}
    for short, metric in _METRICS.items():
        made[f"topk_{short}"] = _topk(metric, False)
        made[f"topk_{short}_scaled"] = _topk(metric, True)
        made[f"join_{short}"] = _join(metric)
    for f in (topk_filter_pre, topk_offset, cosine_rewrite, min_by_k, within_radius, match, knn_join, knn_join_group, ivf_filter_post, ivf_filter_pre, ivf_knn_join, spann_dedup, delete_then_search, insert_then_search, compact_then_search, index_info):
        made[f.__name__] = f
    made["ivf_exhaustive"] = _indexed("ivf", nlist=16)
    made["ivf_cosine_exhaustive"] = _indexed("ivf", nlist=16, metric="cosine", normalize_cells=True)
    made["spann_exhaustive"] = _indexed("spann", nlist=16)
    made["rabitq_rerank"] = _indexed("ivf", nlist=16, quantizer="rabitq", bits=3)
    made["pq_rerank"] = _indexed("ivf", nlist=16, quantizer="pq", metric="ip")
    made["scann_rerank"] = _indexed("ivf", nlist=16, quantizer="scann")
    made["ivf_default"] = _index_join("ivf", nlist=32, nprobe=8, rerank=10, quantizer="rabitq", bits=3)
    made["spann_default"] = _index_join("spann", nlist=32, nprobe=8)
    made["hnsw"] = _index_join("hnsw")
    made["diskann"] = _index_join("diskann", quantizer="rabitq", bits=4, rerank=10)
    made["rabitq_join"] = _index_join("ivf", nlist=16, quantizer="rabitq", bits=3, rerank=10)
    made["pq_join"] = _index_join("ivf", nlist=16, quantizer="pq", metric="ip", rerank=10)
    made["scann_join"] = _index_join("ivf", nlist=16, quantizer="scann", rerank=10)
    for name, (algorithm, options) in _RECALLS.items():
        made[name] = _recall(algorithm, **options)
    return made


def oracle_sql() -> dict[str, str]:
    made = {}
    for short in _METRICS:
        made[f"topk_{short}"] = _sql_top(short)
        made[f"topk_{short}_scaled"] = _sql_top(short, _SCALED)
        made[f"join_{short}"] = _sql_vector_join(short)
    made["topk_filter_pre"] = _sql_top("l2", where="label = 3")
    made["topk_offset"] = _sql_top("l2", offset=15)
    made["cosine_rewrite"] = _sql_top("cosine")
    made["min_by_k"] = f"SELECT vec_id FROM ({_sql_top('l2')})"
    made["within_radius"] = _sql_top("l2", where=f"{_sql_distance('l2', 'e.v', 'q.v')} <= 1.2", k=1_000_000_000)
    made["match"] = f"SELECT round(1 - distance, 6) AS score, vec_id FROM ({_sql_top('cosine', _SCALED, k=5)})"
    made["knn_join"] = made["ivf_knn_join"] = made["spann_dedup"] = _sql_join("l2", K)
    made["knn_join_group"] = f"SELECT query_id, label, count(*) AS n FROM ({_sql_join('l2', K)}) JOIN embeddings ON key = vec_id GROUP BY ALL"
    for name in ("ivf_exhaustive", "spann_exhaustive", "rabitq_rerank", "scann_rerank", "insert_then_search"):
        made[name] = _sql_top("l2", _SCALED)
    for name in _RECALLS:
        made[name] = f"SELECT sum(least({K}, n)) ::BIGINT AS neighbours, TRUE AS enough FROM (SELECT (SELECT count(*) FROM embeddings) AS n FROM embeddings WHERE vec_id % 100 = 0)"
    made["index_info"] = "SELECT 'spann' AS index_type, 'l2sq' AS metric, 'rabitq' AS quantizer, 64 AS dimensions, 36 AS code_size, 16 AS nlist, count(*) AS count FROM embeddings"
    made["ivf_filter_pre"] = _sql_top("l2", _SCALED, "label = 3")
    made["ivf_filter_post"] = f"SELECT vec_id, distance FROM ({_sql_top('l2', _SCALED)}) JOIN embeddings USING (vec_id) WHERE label < 5"
    made["ivf_cosine_exhaustive"] = _sql_top("cosine", _SCALED)
    made["pq_rerank"] = _sql_top("ip", _SCALED)
    made["delete_then_search"] = made["compact_then_search"] = _sql_top("l2", _SCALED, "label <> 3")
    return made
