"""Connected components of a link table, by alternating star contraction.

Every step is a grouped minimum and a join, so no task holds the links of one node, and
the rows never outnumber the links. The joins are on a hash beside the node: both sides are then
shuffled for the join, and adaptive execution can split the links of a node that has most of them, which
it can't where one side comes grouped by the node. Each round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import stored


def _state(links: DataFrame):
    return links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()


def _joined(links: DataFrame, least: DataFrame) -> DataFrame:
    """Each link with the smallest neighbour ``m`` of its ``u``."""
    keyed = links.withColumn("key", F.xxhash64("u"))
    return keyed.join(least.withColumn("least_key", F.xxhash64("node")), F.col("key") == F.col("least_key")).where("u = node")


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("m")
    )
    larger = both.where("v > u")
    return _joined(larger, least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), "m")
    moved = _joined(links, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).where("u > v")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for each node but the roots.

    ``links`` has comparable columns ``u`` and ``v``, in any order and with repeats.
    """
    links = stored(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _state(links)
    while before[0]:
        links = stored(_small_star(_large_star(links).distinct()).distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
