"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least(edges: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """node and component (its least reachable node) of each node that a link (a, b) touches.

    Nodes are longs; links may repeat, stand in either direction, and join a node
    to itself; links with a null end are left out. Stars are contracted in turns:
    each node hands its larger neighbours, then its smaller ones, to its least
    neighbour, until no link changes. No group is gathered: minima are aggregated
    map-side and joined back, so a hub's links stay spread over tasks. The links
    of each turn are a written table, and only their number and checksum reach
    the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    edges = materialize(edges, "links")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    # every link now leads from a node to its component
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
