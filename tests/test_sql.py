"""SQL text that an index answers, against the same text answered by Spark alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import register
from nearfield.plans.catalog import Catalog
from nearfield.plans.index import VectorIndex

TABLE = "sql_items"
QUERY = "array(0.1, 0.2, -0.3, 0.4)"


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    register(spark)
    x = np.random.default_rng(3).standard_normal((400, 4)).round(3)
    rows = [(i, v, i % 7) for i, v in enumerate(x.tolist())]
    items = spark.createDataFrame([*rows, (900, None, 1)], "vec_id long, embedding array<double>, shelf int")
    items.createOrReplaceTempView(TABLE)
    made = Catalog()
    made.register("by_l2", TABLE, VectorIndex.build(items, str(tmp_path_factory.mktemp("sql") / "l2"), "ivf", nlist=8, nprobe=8))
    made.register("by_cosine", TABLE, VectorIndex.build(items, str(tmp_path_factory.mktemp("sql") / "cos"), "hnsw", metric="cosine"))
    return made


@pytest.mark.parametrize(
    ("index", "text"),
    [
        ("by_l2", f"SELECT vec_id FROM {TABLE} ORDER BY array_distance(embedding, {QUERY}) ASC NULLS LAST LIMIT 5"),
        ("by_l2", f"SELECT t.vec_id, 2 * shelf AS s, array_distance({QUERY}, t.embedding) AS d FROM {TABLE} t WHERE t.shelf IN (2, 3) AND embedding IS NOT NULL ORDER BY d LIMIT 40"),
        ("by_l2", f"SELECT vec_id FROM {TABLE} WHERE embedding IS NOT NULL ORDER BY array_distance(embedding, {QUERY}) LIMIT 4 OFFSET 3"),
        ("by_cosine", f"SELECT * FROM {TABLE} WHERE shelf = 5 ORDER BY array_cosine_distance(embedding, {QUERY}) NULLS LAST LIMIT 3"),
        (None, f"SELECT vec_id FROM {TABLE} ORDER BY array_distance(embedding, {QUERY}) DESC NULLS LAST LIMIT 5"),
        (None, f"SELECT vec_id FROM {TABLE} ORDER BY array_distance(embedding, {QUERY}) NULLS LAST, vec_id LIMIT 5"),
        (None, f"SELECT vec_id FROM {TABLE} ORDER BY array_negative_inner_product(embedding, {QUERY}) NULLS LAST LIMIT 5"),
        (None, f"SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM {TABLE} ORDER BY array_distance(embedding, {QUERY}) NULLS LAST LIMIT 5"),
        (None, f"SELECT vec_id FROM {TABLE} ORDER BY array_distance(embedding, embedding) NULLS LAST, vec_id LIMIT 5"),
        (None, f"SELECT shelf, count(*) AS n FROM {TABLE} GROUP BY shelf ORDER BY shelf LIMIT 3"),
        (None, f"SELECT DISTINCT shelf, array_distance(embedding, {QUERY}) AS d FROM {TABLE} ORDER BY d NULLS LAST LIMIT 5"),
        (None, f"SELECT vec_id FROM {TABLE} WHERE vec_id > (SELECT min(shelf) FROM {TABLE}) ORDER BY array_distance(embedding, {QUERY}) NULLS LAST LIMIT 5"),
    ],
)
def test_nearest_rows_by_sql(spark, catalog, index, text):
    assert catalog.index_for(spark, text) == index
    found = catalog.sql(spark, text)
    plain = Catalog().sql(spark, text)
    assert found.columns == plain.columns
    assert found.collect() == plain.collect()


def test_the_index_does_the_search(spark, catalog):
    text = f"SELECT vec_id FROM {TABLE} ORDER BY array_distance(embedding, {QUERY}) NULLS LAST LIMIT 50"
    exact = [r.vec_id for r in Catalog().sql(spark, text).collect()]
    one_cell = [r.vec_id for r in catalog.sql(spark, text, effort=1).collect()]
    assert one_cell != exact and exact[0] in one_cell
    index = catalog.get("by_l2")
    index.delete(spark.table(TABLE).where(F.col("vec_id") == exact[0]))
    assert [r.vec_id for r in catalog.sql(spark, text).collect()][0] == exact[1]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("nearfield_")]
