"""Kernels against brute force, the options matrix, and an index's life."""

import glob
import itertools
import os
import warnings

import numpy as np
import pytest

from nearfield import operators, queries
from nearfield.kernels import quantizers
from nearfield.kernels.graphs import Layered, Vamana
from nearfield.kernels.kmeans import kmeans
from nearfield.kernels.metrics import pairwise
from nearfield.plans import Options
from nearfield.plans.catalog import Catalog
from nearfield.plans.index import VectorIndex
from nearfield.sources import read_fvecs


def gauss(n, d, seed):
    return np.random.default_rng(seed).standard_normal((n, d))


def recall(found, exact):
    return np.mean([len(set(a) & set(b)) / len(b) for a, b in zip(found, exact)])


def test_kmeans_finds_blobs_and_repeats_few_samples():
    centres = np.random.default_rng(1).uniform(-10, 10, (8, 16))
    x = np.concatenate([c + 0.1 * gauss(64, 16, i) for i, c in enumerate(centres)])
    made = kmeans(x, 8)
    assert np.sqrt(((made[:, None] - centres[None]) ** 2).sum(axis=2)).min(axis=0).max() < 0.5
    assert np.array_equal(made, kmeans(x, 8))
    assert kmeans(x[:3], 5).shape == (5, 16) and not kmeans(x[:0], 5).any()


@pytest.mark.parametrize(("kind", "options", "rerank", "least"), [("rabitq", {"bits": 1}, 20, 0.9), ("rabitq", {"bits": 3}, 10, 0.99), ("rabitq", {"bits": 8}, 1, 0.95), ("pq", {}, 10, 0.9), ("scann", {"m": 16}, 10, 0.9)])
def test_quantizer_recall(kind, options, rerank, least):
    x, q = gauss(1000, 128, 17), gauss(25, 128, 918273)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        made = quantizers.make(kind, 128, "l2sq", **options)
    made.train(x)
    codes = made.encode(x)
    assert codes.shape == (1000, made.code_size())
    exact = pairwise(q, x, "l2sq").argsort(axis=1)[:, :10]
    assert recall(made.estimate(q, codes).argsort(axis=1)[:, : 10 * rerank], exact) >= least


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_rabitq_estimates_every_metric(metric):
    x, q = gauss(300, 64, 3), gauss(5, 64, 4)
    made = quantizers.make("rabitq", 64, metric, bits=8)
    made.train(x)
    scale = np.abs(pairwise(q, x, metric)).mean()
    assert np.abs(made.estimate(q, made.encode(x)) - pairwise(q, x, metric)).mean() < 0.05 * scale


def test_rabitq_code_sizes():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert [quantizers.make("rabitq", 128, "l2sq", bits=b).code_size() for b in (1, 2, 3, 4, 5, 7, 8)] == [28, 44, 60, 76, 92, 124, 140]
    with pytest.raises(ValueError, match="bits"):
        quantizers.make("rabitq", 128, "l2sq", bits=6)


@pytest.mark.parametrize("graph", [Layered(16, 32, 100, 6), Vamana(32, 60, 1.2)])
def test_graph_recall(graph):
    x, q = gauss(400, 32, 5), gauss(20, 32, 6)
    graph.build(x, lambda a, b: pairwise(a, b, "l2sq"))
    found = [[i for _, i in graph.search(lambda js, v=v: pairwise(v[None], x[js], "l2sq")[0], 10, 64)] for v in q]
    assert recall(found, pairwise(q, x, "l2sq").argsort(axis=1)[:, :10]) >= 0.85


def test_acceptance_matrix():
    accepted = 0
    for algorithm, quantizer, metric in itertools.product(("hnsw", "ivf", "spann", "diskann"), ("flat", "rabitq", "pq", "scann"), ("l2sq", "cosine", "ip")):
        refused = (algorithm == "diskann" and quantizer == "flat") or (metric == "cosine" and quantizer in ("pq", "scann"))
        if refused:
            with pytest.raises(ValueError, match="requires a compressing|does not support"):
                Options.of(algorithm, metric, quantizer)
        else:
            accepted += Options.of(algorithm, metric, quantizer).metric == metric
    assert accepted == 37
    for bad in ({"nlist": 1}, {"nprobe": 0}, {"graph_m": 4}):
        with pytest.raises(ValueError):
            Options.of("ivf", **bad)


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(i, [float(a), float(b), float(c)]) for i, (a, b, c) in enumerate(itertools.product(range(1, 10), repeat=3))]
    return spark.createDataFrame([*rows, (900, None)], "vec_id long, embedding array<float>")


def test_exact_search(grid):
    assert [r.distance for r in operators.knn(grid, [5, 5, 5], 3).collect()] == [0, 1, 1]
    assert [r.vec_id for r in operators.knn(grid, [5, 5, 5], 2, offset=1).collect()] == [r.vec_id for r in operators.knn(grid, [5, 5, 5], 3).collect()][1:]
    assert operators.knn_join(grid, grid, 0).count() == 0


@pytest.mark.parametrize(("algorithm", "options"), [("spann", {"nlist": 8, "replica_count": 4, "closure_factor": 2.0}), ("hnsw", {"graph_m": 8, "ef_construction": 30, "shard_rows": 400})])
def test_life_of_an_index(spark, grid, tmp_path, algorithm, options):
    index = VectorIndex.build(grid, f"file://{tmp_path}/a", algorithm, **options)
    full = options.get("nlist")
    assert [r.distance for r in index.search([5, 5, 5], 3, effort=full).collect()] == [0, 1, 1]
    index.delete(grid.where("vec_id = 364"))  # (5, 5, 5)
    assert [r.distance for r in index.search([5, 5, 5], 3, effort=full).collect()] == [1, 1, 1]
    index.insert(grid.where("vec_id = 364"))
    again = VectorIndex.load(spark, index.path, grid)
    assert [r.distance for r in again.search([5, 5, 5], 3, effort=full).collect()] == [0, 1, 1]
    assert again.info().first()["count"] == 729


def test_catalog_and_files(spark, grid, tmp_path):
    catalog = Catalog()
    assert catalog.top_k("t", grid, [1, 1, 1], 1).first().distance == 0
    data = b"".join(np.array([3], "<i4").tobytes() + np.array(v, "<f4").tobytes() for v in ([1, 2, 3], [4, 5, 6]))
    (tmp_path / "x.fvecs").write_bytes(data)
    assert [r.vec for r in read_fvecs(spark, f"{tmp_path}/x.fvecs").orderBy("id").collect()] == [[1, 2, 3], [4, 5, 6]]


@pytest.mark.parametrize("name", ["ivf_default", "spann_default", "hnsw", "diskann", "rabitq_join", "pq_join", "scann_join"])
def test_recall_of_index_joins(spark, name):
    folder = "/root/testdata/sf0.1"
    df = queries._scaled(queries._table(spark, folder))
    asked = df.where("vec_id % 100 = 0")
    exact, found = {}, {r.vec_id: set() for r in asked.select("vec_id").collect()}
    for r in operators.knn_join(asked, df, queries.K, metric="ip" if name == "pq_join" else "l2sq").collect():
        exact.setdefault(r.query_id, set()).add(r.key)
    for r in queries.queries()[name](spark, folder).collect():
        found[r.query_id].add(r.key)
    assert len(found) == 20 and all(len(x) == queries.K for x in found.values())
    assert recall([found[q] for q in exact], list(exact.values())) >= 0.9


def test_join_counts_rows_of_repeated_keys(spark):
    rows = [(1, [0.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, None, "c"), (3, [3.0, 0.0], "d"), (3, [3.0, 0.0], "d")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, tag string")
    made = operators.vector_join(table, table, "embedding", "embedding", 2, left_key="vec_id", right_key="vec_id").collect()
    pairs = sorted((r.left_tbl.tag, r.right_tbl.tag, r.score) for r in made)
    assert pairs == [("a", "a", 0.0), ("a", "b", 1.0), ("b", "a", 1.0), ("b", "b", 0.0)] + [("d", "d", 0.0)] * 4


def test_a_query_without_a_vector_stays_in_an_outer_join(spark):
    table = spark.createDataFrame([(1, [0.0]), (2, None), (3, [1.0])], "vec_id long, embedding array<double>")
    made = operators.knn_join(table, table, 1, outer=True).collect()
    assert sorted((r.query_id, r.key) for r in made if r.key is not None) == [(1, 1), (3, 3)]
    assert [r.query_id for r in made if r.key is None] == [2]


def test_every_accepted_combination_is_built_and_searched(spark, tmp_path):
    values = np.random.default_rng(4).normal(size=(40, 16)).round(3)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(values)], "vec_id long, embedding array<float>").cache()
    small = {"hnsw": {}, "ivf": {"nlist": 4, "nprobe": 4}, "spann": {"nlist": 4, "nprobe": 4, "replica_count": 2}, "diskann": {"degree": 8, "l_build": 40}}
    tried = 0
    for algorithm, options in small.items():
        for quantizer in ("flat", "rabitq", "pq", "scann"):
            for metric in ("l2sq", "cosine", "ip"):
                try:
                    Options.of(algorithm, metric, quantizer)
                except ValueError:
                    continue
                more = {"bits": 4, "pq_m": 4} if quantizer in ("pq", "scann") else {}
                index = VectorIndex.build(table, str(tmp_path / f"{algorithm}-{quantizer}-{metric}"), algorithm, metric=metric, quantizer=quantizer, rerank=4, **options, **more)
                found = [r.vec_id for r in index.search(values[7].tolist(), 10).collect()]
                exact = [r.vec_id for r in operators.knn(table, values[7].tolist(), 10, metric=metric).collect()]
                assert len(found) == 10 and len(set(found) & set(exact)) >= 9, (algorithm, quantizer, metric)
                tried += 1
    assert tried == 37


def test_an_insert_that_ends_early_loses_nothing(spark, grid, tmp_path, monkeypatch):
    index = VectorIndex.build(grid, str(tmp_path / "i"), "ivf", nlist=4, nprobe=4)
    before = len(glob.glob(str(tmp_path / "i/tombstones/*.parquet")))
    moved = grid.limit(3)
    kept = VectorIndex._append

    def ends(self, rows, version):
        kept(self, rows, version)
        raise RuntimeError("ended")

    monkeypatch.setattr(VectorIndex, "_append", ends)
    with pytest.raises(RuntimeError):
        index.insert(moved)
    monkeypatch.undo()
    assert len(glob.glob(str(tmp_path / "i/tombstones/*.parquet"))) == before
    found = index._live(index._stored()).select("vec_id").distinct().count()
    assert found == grid.where("embedding is not null").count()
    taken = sorted(os.listdir(tmp_path / "i/versions"))
    index.insert(moved)
    assert len([x for x in os.listdir(tmp_path / "i/versions") if not x.startswith(".")]) == len([x for x in taken if not x.startswith(".")]) + 1
    assert index._live(index._stored()).count() == found


def test_files_of_an_index_are_bounded_by_its_cells(spark, grid, tmp_path):
    VectorIndex.build(grid.repartition(16), str(tmp_path / "f"), "ivf", nlist=16)
    assert len(glob.glob(str(tmp_path / "f/rows/*/*.parquet"))) <= 2 * 16


def test_settings_order_and_the_drop_guard(spark, grid, tmp_path):
    index = VectorIndex.build(grid, str(tmp_path / "s"), "ivf", nlist=16, nprobe=3)
    assert (index._effort(None), index._effort(5), index._effort(99)) == (3, 5, 16)
    spark.conf.set("nearfield.nprobe", "7")
    assert (index._effort(None), index._effort(5)) == (7, 5)
    spark.conf.set("nearfield.nprobe", "0")
    assert index._effort(None) == 3
    spark.conf.unset("nearfield.nprobe")
    catalog = Catalog()
    catalog.register("i", "t", index)
    with pytest.raises(ValueError):
        catalog.check_drop_column("t", "embedding")
    catalog.check_drop_column("t", "tag")
    catalog.drop("i")
    catalog.check_drop_column("t", "embedding")


@pytest.fixture(scope="module")
def close(spark):
    """Rows of many lengths, and among them copies so near to each other that codes hardly tell them apart."""
    rng = np.random.default_rng(11)
    values = np.concatenate([rng.standard_normal((600, 16)) * rng.integers(1, 9, (600, 1)), rng.standard_normal(16) + 1e-3 * rng.standard_normal((900, 16))])
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(values)], "vec_id long, embedding array<double>").cache()


@pytest.mark.parametrize(("algorithm", "options"), [("ivf", {"nlist": 4, "nprobe": 4, "quantizer": "pq", "metric": "ip", "rerank": 10}), ("ivf", {"nlist": 4, "nprobe": 4, "quantizer": "rabitq", "bits": 3, "rerank": 10}), ("ivf", {"nlist": 4, "nprobe": 4, "quantizer": "scann", "rerank": 10})])
def test_codes_lose_no_neighbour_in_the_cells_probed(spark, close, tmp_path, algorithm, options):
    options = {"pq_m": 4, "bits": 4} | options if options["quantizer"] != "rabitq" else options
    index = VectorIndex.build(close, str(tmp_path / "c"), algorithm, **options)
    metric = options.get("metric", "l2sq")
    for query_id in (5, 700):
        query = list(close.where(f"vec_id = {query_id}").first().embedding)
        exact = [r.vec_id for r in operators.knn(close, query, 10, metric=metric).collect()]
        assert [r.vec_id for r in index.search(query, 10).collect()] == exact
        odd = [r.vec_id for r in operators.knn(close, query, 10, metric=metric, where="vec_id % 3 = 1", offset=2).collect()]
        assert [r.vec_id for r in index.search(query, 10, where="vec_id % 3 = 1", offset=2).collect()] == odd


def test_a_join_loses_no_neighbour_in_the_cells_probed(spark, close, tmp_path):
    index = VectorIndex.build(close, str(tmp_path / "j"), "spann", nlist=8, nprobe=8, replica_count=4, closure_factor=4.0, quantizer="scann", pq_m=4, bits=4, rerank=2)
    asked = close.where("vec_id % 100 = 0")
    exact = sorted((r.query_id, r.key, r.rank) for r in operators.knn_join(asked, close, 10).collect())
    assert sorted((r.query_id, r.key, r.rank) for r in index.knn_join(asked, 10).collect()) == exact


@pytest.mark.parametrize("graph", [Layered(4, 8, 10, 4), Vamana(4, 4, 1.0)])
def test_every_row_of_a_graph_can_be_reached(graph):
    x = np.concatenate([gauss(60, 8, 1), 9 + 1e-6 * gauss(200, 8, 2), np.zeros((40, 8))])
    graph.build(x, lambda a, b: pairwise(a, b, "l2sq"))
    graph.join_up(x, lambda a, b: pairwise(a, b, "l2sq"))
    assert sorted(i for _, i in graph.search(lambda js: pairwise(x[:1], x[js], "l2sq")[0], len(x), len(x))) == list(range(len(x)))


SMALL_HNSW, SMALL_DISKANN = {"graph_m": 4, "ef_construction": 8, "ef_search": 10}, {"degree": 8, "l_build": 10}


@pytest.mark.parametrize(("algorithm", "options"), [
    ("diskann", SMALL_DISKANN | {"quantizer": "pq", "pq_m": 4, "bits": 4}),
    ("diskann", SMALL_DISKANN | {"quantizer": "rabitq", "bits": 4}),
    ("hnsw", SMALL_HNSW | {"quantizer": "rabitq", "bits": 3}),
    ("hnsw", SMALL_HNSW),
])
def test_a_graph_widens_its_beam_until_it_finds_the_nearest(spark, close, tmp_path, algorithm, options):
    index = VectorIndex.build(close, str(tmp_path / "g"), algorithm, **options)
    asked = close.where("vec_id % 30 = 0")
    exact = {(r.query_id, r.key) for r in operators.knn_join(asked, close, 10).collect()}
    found = {(r.query_id, r.key) for r in index.knn_join(asked, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
