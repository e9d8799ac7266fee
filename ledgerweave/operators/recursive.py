"""Traversals as recursive SQL: a walk carries its depth and the nodes it has visited, so cycles end and every level is one join.

A walk is a row, so these are for graphs, or parts of graphs, whose number of walks is bounded: by depth and fan-out, or as hierarchies are. Searches over
any graph are in `graph`, where a node is a row once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walks(links: DataFrame, starts: DataFrame, most: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, start, node, depth, visited) of all walks from starts(*keys, node) along links(*keys, src, dst) of up to most steps that visit no node twice."""
    if not 0 <= most <= 100:
        raise ValueError("most must be from 0 to 100")
    links.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # most and visited nodes are the bounds
    own = "".join(f"{k}, " for k in keys)
    same = " AND ".join(["w.node = l.src", *(f"w.{k} = l.{k}" for k in keys)])
    walked = "".join(f"w.{k}, " for k in keys)
    return links.sparkSession.sql(
        f"""WITH RECURSIVE walk AS (
  SELECT {own}node AS start, node, 0 AS depth, array(node) AS visited FROM {{starts}}
  UNION ALL
  SELECT {walked}w.start, l.dst, w.depth + 1, array_append(w.visited, l.dst) FROM walk w JOIN {{links}} l ON {same} WHERE w.depth < {most} AND NOT array_contains(w.visited, l.dst))
SELECT * FROM walk""",
        links=links.select(*keys, "src", "dst").distinct(), starts=starts.select(*keys, "node").distinct(),
    )


def distances(links: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, node, hops) of what is reached within most steps, by the shortest walk."""
    return walks(links, starts, most).groupBy("start", "node").agg(F.min("depth").alias("hops"))


def shortest_paths(links: DataFrame, starts: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """(start, node, hops, path) for goals(node): of the shortest paths the least by its nodes."""
    found = walks(links, starts, most).join(goals.select("node").distinct(), "node")
    return found.groupBy("start", "node").agg(F.min(F.struct("depth", "visited")).alias("m")).select("start", "node", F.col("m.depth").alias("hops"), F.col("m.visited").alias("path"))


def longest_levels(links: DataFrame, nodes: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """nodes(*keys, node) with level: how many links the longest way to it has that starts at a node without inflow and visits none twice.

    Where a cycle has no such start, every node of it may be the first: its nodes are reached from any of them.
    """
    inflow = links.select(*keys, F.col("dst").alias("node")).distinct()
    sources = nodes.select(*keys, "node").join(inflow, [*keys, "node"], "left_anti")
    first = walks(links, sources, most, keys)
    reached = first.select(*keys, "node").distinct()
    within = walks(links, nodes.select(*keys, "node").join(reached, [*keys, "node"], "left_anti"), most, keys)
    every = first.select(*keys, "node", "depth").unionByName(within.join(reached, [*keys, "node"], "left_anti").select(*keys, "node", "depth"))
    return every.groupBy(*keys, "node").agg(F.max("depth").alias("level"))


def closure(subclasses: DataFrame, most: int = 20) -> DataFrame:
    """(sub, super, depth) of subclasses(sub, super): every class under itself, at depth 0, and all above it at its least distance."""
    links = subclasses.select(F.col("sub").alias("src"), F.col("super").alias("dst"))
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return distances(links, nodes, most).select(F.col("start").alias("sub"), F.col("node").alias("super"), F.col("hops").alias("depth"))
