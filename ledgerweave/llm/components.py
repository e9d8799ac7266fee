"""Connected components of a graph of any size by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u long, v long); root is the smallest node of its component.

    Nodes without a link to another node may be missing. Each round is two min-aggregations (combined
    before the shuffle) and two equi-joins (which adaptive execution splits where a hub is hot), and ends
    in a checkpoint. An empty graph gives no rows.
    """
    links = durable(_oriented(edges))
    seen = None
    while (now := _state(links)) != seen:
        seen = now
        links = durable(_small_star(_large_star(links)))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _oriented(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node moves to the smallest neighbour of that node, itself included."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, move to its smallest neighbour."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    rest = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(rest).distinct()
