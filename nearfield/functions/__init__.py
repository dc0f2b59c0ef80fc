"""Distance functions as Column expressions and as SQL functions.

All compute in double precision from arrays of any numeric type, inside the
JVM.  A null argument gives null.  The cosine of a zero vector is NaN; index
estimates use 1.0 there instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Vector = Column | str | Sequence[float]


def _column(v: Vector) -> Column:
    if isinstance(v, str):
        v = F.col(v)
    if not isinstance(v, Column):
        v = F.array(*(F.lit(float(x)) for x in v))
    return v.cast("array<double>")


def _sum(a: Vector, b: Vector, term) -> Column:  # noqa: ANN001
    """The sum of term(x, y) over two vectors; unequal lengths give null.

    A constant vector is one literal.  (Unrolling it into 64 terms or more makes
    code beyond the size that the JVM compiles.)
    """
    x, y = _column(a), _column(b)
    total = F.aggregate(F.zip_with(x, y, term), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(x) == F.size(y), total)


def l2sq_distance(a: Vector, b: Vector) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def l2_distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(l2sq_distance(a, b))


def inner_product(a: Vector, b: Vector) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def negative_inner_product(a: Vector, b: Vector) -> Column:
    return -inner_product(a, b)


def cosine_similarity(a: Vector, b: Vector) -> Column:
    norm = F.sqrt(inner_product(a, a) * inner_product(b, b)) if isinstance(a, Column | str) and isinstance(b, Column | str) else F.sqrt(_squares(a) * _squares(b))
    return F.when(norm == 0, F.lit(float("nan"))).otherwise(inner_product(a, b) / norm)


def _squares(v: Vector) -> Column:
    if isinstance(v, Column | str):
        return F.aggregate(_column(v), F.lit(0.0), lambda s, x: s + x * x)
    return F.lit(float(sum(float(x) ** 2 for x in v)))


def cosine_distance(a: Vector, b: Vector) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


DISTANCES = {"l2sq": l2_distance, "cosine": cosine_distance, "ip": negative_inner_product}
SIMILARITIES = {"cosine": cosine_similarity, "ip": inner_product}
#: Other names of the metrics.
ALIASES = {"l2": "l2sq", "cos": "cosine", "l2sq": "l2sq", "cosine": "cosine", "ip": "ip"}


def metric_name(metric: str) -> str:
    try:
        return ALIASES[metric.lower()]
    except KeyError:
        raise ValueError(f"unknown metric {metric!r}; expected one of {sorted(ALIASES)}") from None


_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"
_SQUARE = "aggregate({0}, 0D, (s, v) -> s + v * v)"
_NORM = f"sqrt({_SQUARE.format('a')} * {_SQUARE.format('b')})"
SQL_FUNCTIONS = {
    "array_distance": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))",
    "array_inner_product": _DOT,
    "array_negative_inner_product": f"-{_DOT}",
    "array_cosine_similarity": f"CASE WHEN {_NORM} = 0 THEN double('NaN') ELSE {_DOT} / {_NORM} END",
    "array_cosine_distance": f"1D - CASE WHEN {_NORM} = 0 THEN double('NaN') ELSE {_DOT} / {_NORM} END",
}


def register(spark: SparkSession) -> None:
    """Make the distances usable from ``spark.sql``.

    Spark takes no such function right in ORDER BY: name it in the select list and
    order by the name, or use ``Catalog.sql``.
    """
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
