"""Keeping an index up to date from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from nearfield.plans.index import VectorIndex


def insert_stream(index: VectorIndex, rows: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer that inserts each micro-batch; a batch that is run again replaces its own rows."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index.insert(batch)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
