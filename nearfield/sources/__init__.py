"""Readers for vector files and Arrow tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _vectors(kind: str):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                if not len(data):
                    continue
                dim = int(np.frombuffer(data, "<i4", 1)[0])
                if dim <= 0 or len(data) % (4 * (dim + 1)):
                    raise ValueError("not a file of equally long vectors")
                rows = np.frombuffer(data, "<i4").reshape(-1, dim + 1)
                if (rows[:, 0] != dim).any():
                    raise ValueError("vectors differ in length")
                values = rows[:, 1:] if kind == "int" else np.ascontiguousarray(rows[:, 1:]).view("<f4")
                for at in range(0, len(values), 10_000):
                    part = values[at : at + 10_000]
                    yield pd.DataFrame({"id": np.arange(at, at + len(part)), "vec": list(part)})

    return run


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """id (place in its file) and vec array<float>: an int32 length and that many float32, row by row."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_vectors("float"), "id long, vec array<float>")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    """Likewise with int32 values."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_vectors("int"), "id long, vec array<int>")


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    """An Arrow table; fixed-size lists become arrays."""
    for i, f in enumerate(table.schema):
        if pa.types.is_fixed_size_list(f.type):
            table = table.set_column(i, f.name, table.column(i).cast(pa.list_(f.type.value_type)))
    return spark.createDataFrame(table)


def checked_dim(df: DataFrame, column: str, dim: int) -> DataFrame:
    """``df``, failing at run time on a vector of another length."""
    ok = F.col(column).isNull() | (F.size(column) == dim)
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"a vector's length is not {dim}")).cast("boolean")))
