"""What the operators share: reading tables and writing intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_own_folder: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor can read.

    ``spark.checkpoint.dir`` names it.  Where it is unset a temporary folder is
    used, but only on a local master: elsewhere executors could not see it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir is unset; set it to a folder that all executors share")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="nearfield-")
    return _own_folder[context.applicationId]


#: Bytes of an Arrow batch that goes to a Python worker, so that rows of any length are held in small numbers.
ARROW_BYTES = 8 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_arrow(df: DataFrame) -> DataFrame:
    """``df``; its session sends Arrow batches of at most ``ARROW_BYTES`` (or one row) from now on."""
    conf = df.sparkSession.conf
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", conf.get(_ARROW).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > ARROW_BYTES:
        conf.set(_ARROW, str(ARROW_BYTES))
    return df


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, lets a result
    be used several times without being computed again, and leaves Spark free
    to redistribute it (a checkpoint would keep the old partitioning, under
    which a skewed join cannot be split).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}-{label}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the map that ``only_wanted`` broadcasts: 16 MB, whatever the input's size.
WANTED_BITS = 1 << 27
_ROW_BITS = 1 << 15


def only_wanted(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``df`` without most of the rows whose ``key`` isn't in ``wanted`` (one column).

    To be put before a join, so that those rows aren't shuffled.  The map has one
    bit for each of ``WANTED_BITS`` hashes of a key; rows that share a bit with a
    wanted key pass, so the join itself still decides.
    """
    hashed = F.pmod(F.xxhash64(F.col(wanted.columns[0])), F.lit(WANTED_BITS))
    maps = wanted.select(hashed.alias("bit")).groupBy(F.floor(F.col("bit") / _ROW_BITS).alias("__nf_row")).agg(F.bitmap_construct_agg(F.col("bit") % _ROW_BITS).alias("__nf_map"))
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(WANTED_BITS))
    at = bit % _ROW_BITS
    byte = F.conv(F.hex(F.substring(F.col("__nf_map"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn("__nf_row", F.floor(bit / _ROW_BITS)).join(F.broadcast(maps), "__nf_row")
    return joined.where(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*df.columns)


@contextlib.contextmanager
def only_last_stays() -> Iterator[None]:
    """Of the tables that are staged within the block, only the last one stays."""
    mark = len(_written)
    yield
    _drop(_written[mark:-1])
    del _written[mark:-1]


def drop_staged() -> None:
    """Delete every table that ``stage`` wrote; their data frames end with it."""
    _drop(_written)
    _written.clear()


def _drop(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        with contextlib.suppress(Exception):  # the session may have ended before
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


atexit.register(drop_staged)
