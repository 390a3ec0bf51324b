"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import park


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest node around it."""
    both = links.select(F.col("lo").alias("at"), F.col("hi").alias("near")).unionAll(
        links.select(F.col("hi").alias("at"), F.col("lo").alias("near")))
    # Parked, both sides of the join are plain shuffles, so a hub's links can be split.
    least = park(
        both.groupBy("at").agg(F.min("near").alias("low"))
        .select(F.col("at").alias("lo"), F.least("at", "low").alias("low")), "star")
    return links.join(least, "lo").select("hi", F.col("low").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and it itself, move to the smallest of them."""
    least = park(links.groupBy("hi").agg(F.min("lo").alias("low")), "star")
    moved = links.join(least, "hi").where(F.col("lo") > F.col("low")).select(
        F.col("lo").alias("hi"), F.col("low").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("low").alias("lo"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    ``links`` has two long columns, in any order and with repeats.  A round costs a
    few shuffles of the links, which never grow in number of nodes; the number of
    rounds grows with the logarithm of the nodes.  Each round is written to the
    shared folder; the driver sees a count and a checksum.
    """
    a, b = links.columns
    links = park(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    seen, now = None, _digest(links)
    while now != seen:
        links = park(_small_star(park(_large_star(links), "large")), "small")
        seen, now = now, _digest(links)
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
