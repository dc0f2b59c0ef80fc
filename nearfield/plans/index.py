"""Approximate indexes over an embedding column, stored as parquet.

Layout below the index's path::

    meta/        one JSON line: options, column, key, dimension
    model/       trained arrays: centroids, rotation, codebooks
    rows/        inverted files: vec_id, version, code, slack, partitioned by cell
                 graphs: vec_id, version, code, slack, partitioned by shard
    graphs/      graphs only: one pickled graph for each shard
    tombstones/  vec_id, version
    versions/    one empty file for each version that a writer has taken

A build trains on a bounded sample (the first rows by a hash of the key); encoding,
assignment and graph building run on the executors.  A search estimates
distances from codes where the cells that the query probes (or the shards)
lie, keeps ``k * rerank`` candidates, and ranks those by their exact distance to
the base table's vectors.  Estimates alone would lose rows that codes hardly tell
apart, so inverted files also rank every row that the error of its code (``slack``)
leaves among the k nearest: in the cells probed, no neighbour is lost to codes.
Graphs are built from the rows themselves; each shard's build measures how wide a
walk over its codes has to be (``GOAL``), and with lossy codes all rows that such a
walk keeps are ranked.

Inserts and deletes add files under a new version: a row counts unless a later
tombstone names it.  ``compact`` rewrites what counts.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import DISTANCES
from nearfield.kernels import quantizers
from nearfield.kernels.graphs import Layered, Vamana
from nearfield.kernels.kmeans import kmeans, squared
from nearfield.kernels.metrics import pairwise, unit
from nearfield.operators import query_blocks
from nearfield.plans import Options, setting

QUANTIZER_SAMPLE, CENTROID_SAMPLE = 65_536, 131_072
#: Candidates of a search that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A graph's beam is widened until walks from ``ASKED`` of a shard's rows find the share ``GOAL`` of their ``NEAR`` nearest.
ASKED, NEAR, GOAL = 64, 10, 0.97


def _by_cell(rows: DataFrame) -> DataFrame:
    """Rows dealt by cell, so that a cell has few files; large cells are split, small ones put together."""
    return rows.hint("rebalance", "cell")


def _codes(batch: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(batch), np.uint8).reshape(len(batch), -1)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, base: DataFrame, meta: dict, model: dict[str, np.ndarray]) -> None:
        self.spark, self.path, self.base, self.meta = spark, path.rstrip("/"), base, meta
        self.options = Options(meta["algorithm"], meta["metric"], meta["quantizer"], meta["values"], meta["quantizer_values"])
        self.column, self.key, self.dim = meta["column"], meta["key"], meta["dim"]
        self.centroids = model.get("centroids")
        self.quantizer = quantizers.make(meta["quantizer"], max(1, self.dim), meta["metric"], **meta["quantizer_values"])
        self.quantizer.state.update({k: v for k, v in model.items() if k != "centroids"})

    # building -----------------------------------------------------------------

    @classmethod
    def build(cls, base: DataFrame, path: str, algorithm: str, *, column: str = "embedding", key: str = "vec_id", metric: str = "l2sq", quantizer: str = "flat", dim: int | None = None, **options: object) -> VectorIndex:
        """Build an index of ``base`` at ``path`` and return it.  Null vectors are left out."""
        chosen = Options.of(algorithm, metric, quantizer, **options)
        spark = base.sparkSession
        kind = base.schema[column].dataType.simpleString()
        if not kind.startswith("array<") or kind[6:-1] not in ("float", "double", "int", "bigint"):
            raise ValueError(f"{column} is {kind}; an index needs an array of numbers")
        rows = cls._rows(base, column, key)
        sizes = [r.n for r in rows.select(F.size("vec").alias("n")).distinct().limit(2).collect()]
        if len(sizes) > 1:
            raise ValueError(f"vectors of {column} differ in length")
        dim = sizes[0] if sizes else dim
        if dim is None:
            raise ValueError("an empty table needs dim=")
        meta = {"algorithm": chosen.algorithm, "metric": chosen.metric, "quantizer": chosen.quantizer, "values": chosen.values, "quantizer_values": chosen.quantizer_values, "column": column, "key": key, "dim": dim, "count": 0}
        index = cls(spark, path, base, meta, {})
        index._train(rows, bool(sizes))
        index._write_meta("errorifexists")
        spark.createDataFrame([], "vec_id long, version int").write.parquet(f"{index.path}/tombstones")
        index._append(rows, 0)
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str, base: DataFrame) -> VectorIndex:
        """Open an index; ``base`` is the table (or a later state of it) that holds the vectors."""
        path = path.rstrip("/")
        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
        model = {r["name"]: np.frombuffer(r.data, r.kind).reshape(r.shape) for r in spark.read.parquet(f"{path}/model").collect()}
        return cls(spark, path, base, meta, model)

    @staticmethod
    def _rows(base: DataFrame, column: str, key: str) -> DataFrame:
        return base.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vec")).where("vec is not null")

    def _train(self, rows: DataFrame, any_rows: bool) -> None:
        v = self.options.values
        if not any_rows:
            if self.options.quantizer != "flat":
                raise ValueError(f"a {self.options.quantizer} quantizer can't be trained on an empty table")
            if "nlist" in v:
                self.centroids = kmeans(np.zeros((0, self.dim)), v["nlist"])
            return
        limit = CENTROID_SAMPLE if "nlist" in v else QUANTIZER_SAMPLE
        order = (F.xxhash64("vec_id"), F.col("vec_id"))
        picked = rows.select("vec_id", F.col("vec").cast("array<float>").alias("vec")).orderBy(*order).limit(limit).select("vec").toArrow()
        sample = picked.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim).astype(np.float64)
        self.quantizer.train(sample[:QUANTIZER_SAMPLE])
        if "nlist" in v:
            made = kmeans(self._cell_space(sample), v["nlist"])
            _, first = np.unique(made, axis=0, return_index=True)
            self.centroids = made[np.sort(first)]  # a small table repeats centroids; probes aren't spent on copies

    def _cell_space(self, x: np.ndarray) -> np.ndarray:
        return unit(x) if self.options.values.get("normalize_cells") else x

    def _write_meta(self, mode: str) -> None:
        self.spark.createDataFrame([(json.dumps(self.meta),)], "value string").coalesce(1).write.mode(mode).text(f"{self.path}/meta")
        model = dict(self.quantizer.state) | ({} if self.centroids is None else {"centroids": self.centroids})
        rows = [(k, np.ascontiguousarray(a).tobytes(), str(a.dtype), list(a.shape)) for k, a in model.items()]
        self.spark.createDataFrame(rows, "name string, data binary, kind string, shape array<int>").coalesce(1).write.mode(mode).parquet(f"{self.path}/model")

    # writing rows --------------------------------------------------------------

    @property
    def _graph(self) -> bool:
        return self.options.algorithm in ("hnsw", "diskann")

    def cells_of(self, x: np.ndarray) -> list[np.ndarray]:
        """The cells each row is stored in: the nearest one, and with closure all
        of the nearest ``replica_count`` within ``closure_factor`` of its squared distance."""
        v = self.options.values
        d = squared(self._cell_space(x), self.centroids)
        if self.options.algorithm == "ivf":
            return [np.array([c]) for c in d.argmin(axis=1)]
        order = np.argsort(d, axis=1, kind="stable")[:, : v["replica_count"]]
        near = np.take_along_axis(d, order, 1)
        ok = near <= v["closure_factor"] * near[:, :1]
        ok[:, 0] = True
        return [o[k] for o, k in zip(order, ok, strict=True)]

    def _append(self, rows: DataFrame, version: int) -> None:
        handle = self.spark.sparkContext.broadcast(self)  # a model of fixed size
        if self._graph:
            count = rows.count()
            shards = max(1, -(-count // self.options.values["shard_rows"]))
            first = version * 1_000_000
            sharded = rows.withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.lit(shards)) + F.lit(first).cast("long"))
            encoded = sharded.mapInPandas(lambda b: handle.value._encoded(b, False), "vec_id long, code binary, slack double, cell long, vec array<double>").withColumn("version", F.lit(version))
            encoded.drop("vec").repartition("cell").sortWithinPartitions("vec_id").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")
            encoded.groupBy("cell").applyInPandas(lambda pdf: handle.value._built(pdf), "cell long, graph binary").write.mode("append").parquet(f"{self.path}/graphs")
        else:
            encoded = rows.withColumn("cell", F.lit(0)).mapInPandas(lambda b: handle.value._encoded(b, True), "vec_id long, code binary, slack double, cell long").withColumn("version", F.lit(version))
            _by_cell(encoded).write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def __getstate__(self) -> dict:
        """For executors: the model without session and table."""
        return {k: v for k, v in self.__dict__.items() if k not in ("spark", "base")}

    def _encoded(self, batches: Iterator[pd.DataFrame], assign: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            if batch["vec"].map(len).ne(self.dim).any():
                raise ValueError(f"a vector's length is not {self.dim}")
            x = np.stack(batch["vec"].to_numpy()).astype(np.float64)
            made = self.quantizer.encode(x)
            codes, slack = [c.tobytes() for c in made], self.quantizer.slack(x, made) if self.quantizer.compresses else np.zeros(len(x))
            if not assign:
                yield pd.DataFrame({"vec_id": batch["vec_id"], "code": codes, "slack": slack, "cell": batch["cell"], "vec": batch["vec"]})
                continue
            cells = self.cells_of(x)
            at = np.repeat(np.arange(len(batch)), [len(c) for c in cells])
            yield pd.DataFrame({"vec_id": batch["vec_id"].to_numpy()[at], "code": [codes[i] for i in at], "slack": slack[at], "cell": np.concatenate(cells).astype(np.int64)})

    def _built(self, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        codes, v, metric = _codes(pdf["code"]), self.options.values, self.options.metric
        x = np.stack(pdf["vec"].to_numpy()) if "vec" in pdf else self.quantizer.decode(codes)
        graph = Layered(v["graph_m"], v["graph_m0"], v["ef_construction"], v["max_level"]) if self.options.algorithm == "hnsw" else Vamana(v["degree"], v["l_build"], v["alpha"])
        graph.build(x, lambda a, b: pairwise(a, b, metric))
        graph.join_up(x, lambda a, b: pairwise(a, b, metric))
        width = self._width(graph, x, codes, v["ef_search" if self.options.algorithm == "hnsw" else "l_build"])
        blob = pickle.dumps((graph, pdf["vec_id"].to_numpy(), pdf["version"].to_numpy(), codes, width))
        return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])], "graph": [blob]})

    def _width(self, graph: Layered | Vamana, x: np.ndarray, codes: np.ndarray, least: int) -> int:
        """The beam's width, ``least`` or more, at which walks over the codes find ``GOAL`` of the
        nearest rows of up to ``ASKED`` rows of the shard; the widest one finds all it can reach."""
        asked = np.linspace(0, len(x) - 1, min(len(x), ASKED)).astype(int)
        exact = [set(np.lexsort((np.arange(len(x)), d))[:NEAR].tolist()) for d in pairwise(x[asked], x, self.options.metric)]
        width = least
        while width < len(x):
            found = 0.0
            for q, want in zip(x[asked], exact, strict=True):
                at = {j for _, j in graph.search(self._walk(q, codes), width, width)}
                found += len(at & want) / len(want)
            if found >= GOAL * len(asked):
                break
            width *= 2
        return width

    def _walk(self, q: np.ndarray, codes: np.ndarray) -> Callable:
        estimate = self.quantizer.estimator(q)
        return lambda js: estimate(codes[js])

    def _stored(self) -> DataFrame:
        return self.spark.read.schema("vec_id long, code binary, slack double, version int, cell long").parquet(f"{self.path}/rows")

    def _tombstones(self) -> DataFrame:
        return self.spark.read.schema("vec_id long, version int").parquet(f"{self.path}/tombstones").groupBy("vec_id").agg(F.max("version").alias("dead"))

    def _live(self, found: DataFrame) -> DataFrame:
        """Rows (vec_id, version, ...) that no later tombstone names."""
        dead = self._tombstones()
        return found.join(dead, (found["vec_id"] == dead["vec_id"]) & (dead["dead"] > found["version"]), "left_anti")

    # searching -----------------------------------------------------------------

    def _rerank(self, given: int | None) -> int:
        return given or setting(self.spark, "rerank") or self.options.values["rerank"]

    def _effort(self, given: int | None) -> int:
        """Cells to probe, or the beam's width."""
        name = {"hnsw": "ef_search", "diskann": "l_search"}.get(self.options.algorithm, "nprobe")
        own = self.options.values.get("l_build" if name == "l_search" else name)
        effort = given or setting(self.spark, name) or own
        return min(effort, len(self.centroids)) if name == "nprobe" else effort

    @property
    def _bounded(self) -> bool:
        """Whether candidates are completed by the bounds of lossy codes."""
        return not self._graph and self.quantizer.compresses

    def _probed(self, matrix: np.ndarray, effort: int, allowed: DataFrame | None) -> tuple[DataFrame, np.ndarray]:
        """The rows that count in the cells that the queries probe, and those cells of each query."""
        order = np.argsort(squared(self._cell_space(matrix), self.centroids), axis=1, kind="stable")[:, :effort]
        stored = self._live(self._stored().where(F.col("cell").isin(np.unique(order).tolist())))
        return stored if allowed is None else stored.join(allowed, "vec_id", "left_semi"), order

    def _estimates(self, kind: str, ids: list, matrix: np.ndarray, candidates: int, effort: int, spare: int, allowed: DataFrame | None, measured: bool = False) -> DataFrame:
        """(q, vec_id, version, estimate) of the candidates of each query, several a partition."""
        handle = self.spark.sparkContext.broadcast((self, ids, matrix))
        schema = f"q {kind}, vec_id long, version int, estimate double"
        if self._graph:
            graphs = self.spark.read.schema("cell long, graph binary").parquet(f"{self.path}/graphs")
            return graphs.mapInPandas(lambda b: _graph_search(b, handle.value, candidates, spare, effort, measured), schema)
        stored, order = self._probed(matrix, effort, allowed)
        cells = self.spark.sparkContext.broadcast(order)
        if self.options.algorithm == "spann" and len(ids) == 1:
            stored = stored.dropDuplicates(["vec_id", "version"])
        most = candidates * self.options.values.get("replica_count", 1)  # copies of one row may take several places
        return stored.mapInPandas(lambda b: _cell_search(b, handle.value, cells.value, most), schema)

    def _ids(self, where: DataFrame | None) -> DataFrame | None:
        return None if where is None else where.select(F.col(self.key).cast("long").alias("vec_id")).distinct()

    def candidates(self, ids: list, matrix: np.ndarray, candidates: int, *, kind: str = "long", effort: int | None = None, where: DataFrame | None = None) -> DataFrame:
        """(q, vec_id, estimate): the best ``candidates`` of each query by estimate.

        A graph whose effort nobody sets walks with the width that its build measured; with
        lossy codes all rows that such a walk keeps are candidates.
        ``where`` holds the only vec_ids that may be candidates.
        """
        allowed = self._ids(where)
        spare = 0
        if self._graph:  # rows that don't count or aren't allowed stay in the graphs, so more are asked for
            spare = self._tombstones().count() if allowed is None else self.options.values["shard_rows"]
        measured = self._graph and not effort and not setting(self.spark, "ef_search" if self.options.algorithm == "hnsw" else "l_search")
        found = self._estimates(kind, ids, matrix, candidates, self._effort(effort), spare, allowed, measured)
        if self._graph:
            found = self._live(found)
            if allowed is not None:
                found = found.join(allowed, "vec_id", "left_semi")
        if self.options.algorithm == "spann":
            found = found.groupBy("q", "vec_id").agg(F.min("estimate").alias("estimate"))
        if measured and self.quantizer.compresses:
            return found.select("q", "vec_id", "estimate")
        rank = F.row_number().over(Window.partitionBy("q").orderBy("estimate", "vec_id"))
        return found.select("q", "vec_id", "estimate").withColumn("place", rank).where(F.col("place") <= candidates)

    def near_ids(self, query: Sequence[float], limit: int, *, rerank: int | None = None, effort: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """``__nf_near``: ids of the candidates for the ``limit`` nearest rows; broadcast if they are few.

        With lossy codes in inverted files, every row in the probed cells that may lie
        within the exact distance of the ``limit``-th of the best estimates is one too.
        """
        q = np.asarray(query, np.float64)
        if len(q) != self.dim:
            raise ValueError(f"the query has {len(q)} dimensions, the index {self.dim}")
        wanted = max(1, limit * self._rerank(rerank))
        found = self.candidates([0], q[None, :], wanted, effort=effort, where=allowed).select(F.col("vec_id").alias("__nf_near"))
        few = F.broadcast(found) if wanted <= BROADCAST_ROWS else found  # ids of eight bytes
        if not self._bounded or limit < 1:
            return few
        base = self.base if allowed is None else allowed
        ranked = base.join(few, base[self.key] == few["__nf_near"], "left_semi").select(DISTANCES[self.options.metric](self.column, q.tolist()).alias("d"))
        seen = ranked.where("d is not null").orderBy("d").limit(limit).agg(F.count("d").alias("n"), F.max("d").alias("far")).first()
        handle = self.spark.sparkContext.broadcast((self, q[None, :], seen.far if seen.n == limit else float("inf")))
        stored = self._probed(q[None, :], self._effort(effort), self._ids(allowed))[0].select("vec_id", "code", "slack")
        return found.unionAll(stored.mapInPandas(lambda b: _within(b, handle.value), "__nf_near long"))

    def search(self, query: Sequence[float], k: int, *, rerank: int | None = None, effort: int | None = None, offset: int = 0, where: Column | str | None = None, filter_mode: str = "pre") -> DataFrame:
        """The k nearest base rows by exact distance among the candidates, with ``distance``.

        ``where`` with filter_mode "pre" restricts the candidates, so k rows come
        back if there are as many; with "post" it is applied to the candidates.
        """
        if filter_mode not in ("pre", "post"):
            raise ValueError("filter_mode must be 'pre' or 'post'")
        q = np.asarray(query, np.float64)
        if len(q) != self.dim:
            raise ValueError(f"the query has {len(q)} dimensions, the index {self.dim}")
        limit = max(0, k) + offset
        allowed = self.base.where(where) if where is not None and filter_mode == "pre" else None
        found = self.near_ids(query, limit, rerank=rerank, effort=effort, allowed=allowed)
        rows = self.base.join(found, self.base[self.key] == found["__nf_near"], "left_semi")
        if where is not None:
            rows = rows.where(where)
        exact = rows.withColumn("distance", DISTANCES[self.options.metric](self.column, q.tolist()))
        out = exact.orderBy(F.col("distance").asc_nulls_last(), F.col(self.key)).limit(limit)
        return out.offset(offset) if offset else out

    def search_agg(self, value: str, query: Sequence[float], k: int, **how: object) -> DataFrame:
        """One row with ``matches``: ``value`` of the k nearest rows, nearest first."""
        near = self.search(query, k, **how)
        rows = F.array_sort(F.collect_list(F.struct(F.col("distance").alias("d"), F.col(self.key).alias("i"), F.col(value).alias("v"))))
        return near.agg(F.transform(rows, lambda x: x.v).alias("matches"))

    def knn_join(self, queries: DataFrame, k: int, *, query_column: str = "embedding", query_key: str = "vec_id", rerank: int | None = None, effort: int | None = None) -> DataFrame:
        """query_id, key, distance, rank: the k nearest base rows of each query row.

        Queries go out in blocks of a checked size; null query vectors have no match.
        """
        kind = queries.schema[query_key].dataType.simpleString()
        found = self.spark.createDataFrame([], f"q {kind}, vec_id long")
        if k > 0:
            for ids, matrix in query_blocks(queries, query_column, query_key):
                first = k * self._rerank(rerank)
                near = self._nearest(ids, matrix, k, first, kind, effort) if self._bounded else self.candidates(ids, matrix, first, kind=kind, effort=effort).select("q", "vec_id")
                found = found.unionAll(near)
        rows = found.join(self.base.select(F.col(self.key).cast("long").alias("vec_id"), F.col(self.column).alias("v")), "vec_id")
        rows = rows.join(queries.select(F.col(query_key).alias("q"), F.col(query_column).alias("w")), "q")
        rows = rows.select("q", "vec_id", DISTANCES[self.options.metric](F.col("w"), F.col("v")).alias("distance"))
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("distance").asc_nulls_last(), "vec_id"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("vec_id").alias("key"), "distance", "rank")

    def _nearest(self, ids: list, matrix: np.ndarray, k: int, first: int, kind: str, effort: int | None) -> DataFrame:
        """(q, vec_id): the k nearest rows of each query, and those too near to the last for a cut here, in each
        partition of the probed cells; exact distances are taken where codes don't rule a row out."""
        stored, order = self._probed(matrix, self._effort(effort), None)
        rows = stored.select("vec_id", "code", "slack", "cell").join(self._rows(self.base, self.column, self.key).where(F.size("vec") == self.dim), "vec_id")
        handle = self.spark.sparkContext.broadcast((self, ids, matrix, order))
        return rows.mapInPandas(lambda b: _exact_search(b, handle.value, k, first), f"q {kind}, vec_id long").distinct()

    # maintenance ---------------------------------------------------------------

    def _next_version(self) -> int:
        """A version that no other writer has: the first one whose file this writer creates."""
        seen = self._stored().agg(F.max("version")).first()[0]
        dead = self.spark.read.parquet(f"{self.path}/tombstones").agg(F.max("version")).first()[0]
        version = max(-1 if seen is None else seen, -1 if dead is None else dead) + 1
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path
        files = place(self.path).getFileSystem(context._jsc.hadoopConfiguration())
        while not files.createNewFile(place(f"{self.path}/versions/{version}")):
            version += 1
        return version

    def insert(self, rows: DataFrame) -> None:
        """Add rows with the trained model; a known id's older entry no longer counts.

        Rows are written before the tombstones of their older entries: if the writer
        ends in between, both entries count, and none is lost.
        """
        version = self._next_version()
        new = self._rows(rows, self.column, self.key)
        self._append(new, version)
        older = self._stored().where(F.col("version") < version).select("vec_id").distinct()
        known = new.join(older, "vec_id", "left_semi").select("vec_id", F.lit(version).alias("version"))
        known.write.mode("append").parquet(f"{self.path}/tombstones")

    def delete(self, ids: DataFrame) -> None:
        """Ids in the key column no longer count; unknown ones are ignored."""
        version = self._next_version()
        gone = ids.select(F.col(self.key).cast("long").alias("vec_id")).distinct().join(self._stored().select("vec_id").distinct(), "vec_id", "left_semi")
        gone.select("vec_id", F.lit(version).alias("version")).write.mode("append").parquet(f"{self.path}/tombstones")

    def compact(self, path: str) -> VectorIndex:
        """An index at another path, of what counts here: codes are copied, graphs built anew."""
        new = VectorIndex(self.spark, path, self.base, self.meta, dict(self.quantizer.state) | ({} if self.centroids is None else {"centroids": self.centroids}))
        new._write_meta("errorifexists")
        self.spark.createDataFrame([], "vec_id long, version int").write.parquet(f"{new.path}/tombstones")
        live = self._live(self._stored()).withColumn("version", F.lit(0))
        if not self._graph:
            _by_cell(live).write.partitionBy("cell").parquet(f"{new.path}/rows")
            return new
        shards = max(1, -(-live.count() // self.options.values["shard_rows"]))
        live.withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).repartition("cell").write.partitionBy("cell").parquet(f"{new.path}/rows")
        handle = self.spark.sparkContext.broadcast(new)
        new._stored().groupBy("cell").applyInPandas(lambda pdf: handle.value._built(pdf), "cell long, graph binary").write.parquet(f"{new.path}/graphs")
        return new

    def drop(self) -> None:
        """Delete the index's folder."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def info(self) -> DataFrame:
        """One row: what the index is, and how many rows and entries count."""
        live = self._live(self._stored())
        counts = live.agg(F.countDistinct("vec_id").alias("count"), F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("code")), F.lit(0)).alias("code_bytes"))
        o = self.options
        plain = {"index_type": o.algorithm, "metric": o.metric, "quantizer": o.quantizer, "dimensions": self.dim, "code_size": self.quantizer.code_size(), **{k: v for k, v in o.values.items() if v is not None}}
        return counts.select(*(F.lit(v).alias(k) for k, v in plain.items()), "count", "entries", "code_bytes", F.lit(self._tombstones().count()).alias("tombstones"))

    def explain(self) -> str:
        o = self.options
        return f"{o.algorithm.upper()} index on {self.column} ({o.metric}, {o.quantizer}, effort {self._effort(None)}, rerank {self._rerank(None)}) at {self.path}"


def _cell_search(batches: Iterator[pd.DataFrame], job: tuple, cells: np.ndarray, candidates: int) -> Iterator[pd.DataFrame]:
    index, ids, matrix = job
    single = len(ids) == 1
    kept: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for cell, part in batch.groupby("cell") if not single else [(None, batch)]:
            rows = np.arange(len(ids)) if single else np.flatnonzero((cells == cell).any(axis=1))
            if not len(part) or not len(rows):
                continue
            estimate = index.quantizer.estimate(matrix[rows], _codes(part["code"]))
            key, version = part["vec_id"].to_numpy(), part["version"].to_numpy()
            for r, e in zip(rows.tolist(), estimate, strict=True):
                kept.setdefault(r, []).append(_best(e, key, version, candidates))
    for r, parts in kept.items():
        e, key, version = (np.concatenate(x) for x in zip(*parts, strict=True))
        e, key, version = _best(e, key, version, candidates)
        yield pd.DataFrame({"q": [ids[r]] * len(e), "vec_id": key, "version": version.astype(np.int32), "estimate": e})


def _within(batches: Iterator[pd.DataFrame], job: tuple) -> Iterator[pd.DataFrame]:
    """Rows whose distance may be ``far`` or less; one whose code has no known error may."""
    index, matrix, far = job
    for batch in batches:
        if len(batch):
            low = index.quantizer.least(matrix, _codes(batch["code"]), batch["slack"].to_numpy(np.float64))[0]
            yield pd.DataFrame({"__nf_near": batch["vec_id"].to_numpy()[~(low > far + 1e-9 * abs(far))]})


#: Pairs of queries and rows whose bounds are held at once.
_PAIRS = 2_000_000


def _exact_search(batches: Iterator[pd.DataFrame], job: tuple, k: int, first: int) -> Iterator[pd.DataFrame]:
    """The k nearest keys of each query in a partition: the ``first`` by estimate are ranked
    exactly, then all whose bound is not beyond the k-th of those."""
    index, ids, matrix, cells = job
    metric = index.options.metric
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for cell, part in batch.groupby("cell"):
            asked = np.flatnonzero((cells == cell).any(axis=1))
            codes, key, slack = _codes(part["code"]), part["vec_id"].to_numpy(), part["slack"].to_numpy(np.float64)
            x = np.stack(part["vec"].to_numpy()).astype(np.float64)
            step = max(1, _PAIRS // len(part))
            for some in (asked[i : i + step] for i in range(0, len(asked), step)):
                estimate, low = index.quantizer.estimate(matrix[some], codes), index.quantizer.least(matrix[some], codes, slack)
                for r, e, least in zip(some.tolist(), estimate, low, strict=True):
                    old = kept.get(r, (np.zeros(0), np.zeros(0, np.int64)))
                    best = np.argpartition(e, first - 1)[:first] if first < len(e) else np.arange(len(e))
                    d = _exact(matrix[r], x[best], metric)
                    old = _nearest_keys(np.append(old[0], d), np.append(old[1], key[best]), k)
                    if first < len(e):
                        open_ = ~(least > _edge(old[0], k))
                        open_[best] = False
                        more = np.flatnonzero(open_)
                        old = _nearest_keys(np.append(old[0], _exact(matrix[r], x[more], metric)), np.append(old[1], key[more]), k)
                    kept[r] = old
    for r, (_, key) in kept.items():
        yield pd.DataFrame({"q": [ids[r]] * len(key), "vec_id": key})


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2sq":
        return np.sqrt(((x - q) ** 2).sum(axis=1))
    dot = (x * q).sum(axis=1)
    if metric == "ip":
        return -dot
    norm = np.sqrt((x**2).sum(axis=1) * (q**2).sum())
    return 1 - np.divide(dot, norm, out=np.full_like(dot, np.nan), where=norm > 0)


def _edge(d: np.ndarray, k: int) -> float:
    """A distance that no key among the k nearest of sorted ``d`` exceeds, with room for rounding."""
    return d[k - 1] + 1e-9 * abs(d[k - 1]) if len(d) >= k else np.inf


def _nearest_keys(d: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key once by its least distance, nearest first, up to the edge of the k nearest."""
    order = np.lexsort((key, d))
    d, key = d[order], key[order]
    once = np.sort(np.unique(key, return_index=True)[1])
    d, key = d[once], key[once]
    inside = ~(d > _edge(d, k))
    return d[inside], key[inside]


def _best(e: np.ndarray, key: np.ndarray, version: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((key, e))[:n]
    return e[order], key[order], version[order]


def _graph_search(batches: Iterator[pd.DataFrame], job: tuple, candidates: int, spare: int, effort: int, measured: bool) -> Iterator[pd.DataFrame]:
    index, ids, matrix = job
    for batch in batches:
        for blob in batch["graph"]:
            graph, key, version, codes, *known = pickle.loads(blob)  # noqa: S301  written by this index
            width = max(effort, candidates, *(known if measured else [])) + (spare if measured else 0)
            width = max(width, candidates + spare)
            most = width if measured and index.quantizer.compresses else candidates + spare
            for i, q in zip(ids, matrix, strict=True):
                found = graph.search(index._walk(q, codes), most, width)
                at = np.array([j for _, j in found], np.int64)
                yield pd.DataFrame({"q": [i] * len(at), "vec_id": key[at], "version": version[at].astype(np.int32), "estimate": [e for e, _ in found]})
