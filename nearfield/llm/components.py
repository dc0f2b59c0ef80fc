"""Connected components of a graph given as a table of links.

Alternates the large-star and small-star steps of Kiveris et al. (2014): each
node's neighbours are hung below the smallest one, until every component is a
star around its smallest node.  All steps are joins and aggregates that combine
before they shuffle; nothing reaches the driver but whether all are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import stage


def _smallest(pairs: DataFrame) -> DataFrame:
    return stage(pairs.groupBy("u").agg(F.min("v").alias("m")), "smallest")


def _are_stars(links: DataFrame) -> bool:
    """Whether every node is either linked to one smaller node only or to larger ones only."""
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("m")).unionAll(links.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("m")))
    node = ends.groupBy("node").agg(F.min("m").alias("least"), F.max("m").alias("most"), F.count_if(F.col("m").isNull()).alias("above"))
    return not node.where("least <> most or (least is not null and above > 0)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (u, v); component is its smallest node.

    Nodes without a link don't appear.  Self-links and repeated links do no harm.
    """
    links = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    while not _are_stars(links):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: a node's larger neighbours are linked to the smallest of all its neighbours and itself
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = stage(large.distinct(), "large")
        # small star: a node and its smaller neighbours are linked to the smallest of them
        small = large.join(_smallest(large), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        links = stage(small.distinct(), "small")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
