"""Traversal of edges(src, dst, predicate, g), undirected unless said otherwise.

A level is one join of the frontier with the edges. Interactive searches are bounded by their limits, so what a level brings to the
driver is at most nodes times (fan-out + 1) rows; searches without limits stay in DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .resolve import small


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, direction, predicate, other, g) from either end."""
    out = edges.select(F.col("src").alias("node"), F.lit("outgoing").alias("direction"), "predicate", F.col("dst").alias("other"), "g")
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.lit("incoming").alias("direction"), "predicate", F.col("src").alias("other"), "g"))


def expand(edges: DataFrame, nodes: DataFrame, fanout: int) -> DataFrame:
    """(node, direction, predicate, other, g, n) for nodes(node): the first fanout + 1 hops of each by direction, predicate, other end and graph. The last tells that there are more."""
    order = Window.partitionBy("node").orderBy("direction", "predicate", "other", "g")
    return both_ways(edges).join(small(nodes), "node").withColumn("n", F.row_number().over(order)).where(F.col("n") <= fanout + 1)


@dataclass
class Neighborhood:
    nodes: list[str]
    edges: list[tuple[str, str, str, str]]
    nodes_truncated: bool = False
    edges_truncated: bool = False
    fanout_truncated: list[str] = field(default_factory=list)


@dataclass
class Path:
    nodes: list[str] = field(default_factory=list)
    edges: list[tuple[str, str, str, str]] = field(default_factory=list)
    found: bool = False
    visited: int = 0
    searched_depth: int = 0
    budget_exhausted: bool = False
    depth_limited: bool = False
    fanout_truncated: bool = False
    exhaustive: bool = False


def _limits(**given: tuple[int, int, int]) -> None:
    for name, (value, least, most) in given.items():
        if not least <= value <= most:
            raise ValueError(f"{name} must be from {least} to {most}")


Edge = tuple[str, str, str, str]


def _level(edges: DataFrame, frontier: list[str], fanout: int) -> dict[str, list[tuple[Edge, str]]]:
    """The hops of each node of the frontier in order, as (edge, other end), of which one more than fanout may come."""
    nodes = edges.sparkSession.createDataFrame([(n,) for n in frontier], "node string")
    edge = F.when(F.col("direction") == "outgoing", F.array("node", "other", "predicate", "g")).otherwise(F.array("other", "node", "predicate", "g"))
    rows = expand(edges, nodes, fanout).select("node", F.struct("n", edge.alias("edge"), "other").alias("hop")).groupBy("node").agg(F.array_sort(F.collect_list("hop")).alias("hops"))
    found = {r["node"]: [(tuple(h["edge"]), h["other"]) for h in r["hops"]] for r in rows.collect()}
    return {n: found.get(n, []) for n in frontier}


def neighborhood(edges: DataFrame, center: str, depth: int = 1, node_limit: int = 100, edge_limit: int = 200, fanout: int = 25) -> Neighborhood:
    """Nodes and edges within depth steps. A hop to a new node beyond node_limit goes with its edge, so no edge lacks an end."""
    _limits(depth=(depth, 1, 2), node_limit=(node_limit, 1, 500), edge_limit=(edge_limit, 1, 1000), fanout=(fanout, 1, 100))
    out, kept, front = Neighborhood([center], []), set(), [center]
    known = {center}
    for _ in range(depth):
        if not front:
            break
        level, begun = _level(edges, front, fanout), len(out.nodes)
        for node, (edge, other) in ((n, h) for n in front for h in [(None, None), *level[n][:fanout]]):
            full = len(kept) == edge_limit
            if edge is None:  # a node begins
                if full:
                    out.edges_truncated = True
                    break
                out.fanout_truncated += [node] * (len(level[node]) > fanout)
            elif edge in kept:
                continue
            elif full:
                out.edges_truncated = True
                break
            elif other not in known and len(known) == node_limit:
                out.nodes_truncated = True
            else:
                out.nodes += [other] * (other not in known)
                known.add(other)
                kept.add(edge)
                out.edges.append(edge)
        front = out.nodes[begun:]
    out.fanout_truncated = sorted({*out.fanout_truncated})
    return out


@dataclass
class _Side:
    """One end of a search: how each node was reached, as (edge, node before), and which are to be expanded."""

    reached: dict[str, tuple[Edge, str] | None]
    front: list[str]

    def trail(self, node: str) -> list[tuple[Edge, str]]:
        steps = []
        while step := self.reached[node]:
            steps.append(step)
            node = step[1]
        return steps


def _advance(level: dict[str, list[tuple[Edge, str]]], side: _Side, other: _Side, out: Path, budget: int, fanout: int) -> str | None:
    """Expands the front of a side until it meets the other side (then the node where it does), or the budget is spent."""
    following: list[str] = []
    try:
        for node in side.front:
            if out.visited >= budget:
                out.budget_exhausted = True
                return None
            out.fanout_truncated |= len(level[node]) > fanout
            for edge, end in level[node][:fanout]:
                if end not in side.reached:
                    side.reached[end] = (edge, node)
                    if end in other.reached:
                        return end
                    if out.visited >= budget:
                        out.budget_exhausted = True
                        return None
                    out.visited += 1
                    following.append(end)
        return None
    finally:
        side.front = following


def find_path(edges: DataFrame, start: str, goal: str, max_depth: int = 4, visit_budget: int = 400, fanout: int = 50) -> Path:
    """A shortest path found from both ends, the smaller frontier first (the start's if they are equal).

    exhaustive tells that nothing was left unseen, so that without a path there is none.
    """
    _limits(max_depth=(max_depth, 1, 6), visit_budget=(visit_budget, 1, 2000), fanout=(fanout, 1, 200))
    sides = [_Side({n: None}, [n]) for n in (start, goal)]
    out, meeting = Path(visited=len({start, goal})), start if start == goal else None
    while meeting is None and not out.budget_exhausted and out.searched_depth < max_depth:
        side, other = sorted(sides, key=lambda s: len(s.front)) if len(sides[0].front) != len(sides[1].front) else sides
        if not side.front:
            break
        out.searched_depth += 1
        meeting = _advance(_level(edges, side.front, fanout), side, other, out, visit_budget, fanout)
    out.found = meeting is not None
    out.depth_limited = not out.found and out.searched_depth >= max_depth
    out.exhaustive = not (out.found or out.budget_exhausted or out.depth_limited or out.fanout_truncated) and not all(s.front for s in sides)
    if out.found:
        forward, back = sides[0].trail(meeting)[::-1], sides[1].trail(meeting)
        out.edges = [e for e, _ in forward + back]
        out.nodes = [*(n for _, n in forward), meeting, *(n for _, n in back)]
    return out


def hops_from(edges: DataFrame, centers: DataFrame, most: int) -> DataFrame:
    """(node, hops) for all nodes within most steps of centers(node), by one join for each step; nodes beyond are left out.

    Edges and every front are kept as tables before the next step reads them, so a step plans one join and not all those before. A neighbour of a front is in that
    front, in the one before it, or new, so no step looks at all that was reached.
    """
    pairs = cut(both_ways(edges).select("node", "other"))
    front = reached = cut(centers.select("node", F.lit(0).alias("hops")).distinct())
    last = front.limit(0)
    for step in range(1, most + 1):
        seen = last.unionByName(front)
        new = front.select("node").join(pairs, "node").select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(step).alias("hops"))
        last, front = front, cut(new) if step < most else new
        reached = reached.unionByName(front)
    return reached


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): ends of edges, a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def flow_levels(links: DataFrame, nodes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """nodes(*keys, node) with level: 0 without inflow in links(*keys, src, dst), else one more than the highest source.

    A node's level is the length of the longest path to it: step k keeps the ends of paths of k links, which become fewer from step
    to step; every fourth step's are kept as a table. most bounds the steps, for cycles too.
    """
    ends = links.select(*keys, F.col("dst").alias("node")).distinct()
    every = nodes.select(*keys, "node", F.lit(0).alias("level"), F.lit(True).alias("_own"))
    for step in range(1, most + 1):
        every = every.unionByName(ends.select(*keys, "node", F.lit(step).alias("level"), F.lit(False).alias("_own")))
        if step < most:
            ends = links.join(ends.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi").select(*keys, F.col("dst").alias("node")).distinct()
            ends = cut(ends) if step % 4 == 0 else ends
    return every.groupBy(*keys, "node").agg(F.max("level").alias("level"), F.max("_own").alias("_own")).where("_own").drop("_own")


def merged(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Graphs put together: of a node the first graph's row stays, of an edge the last one's."""
    def pick(frames: list[DataFrame], keys: list[str], first: bool) -> DataFrame:
        every = frames[0].withColumn("_k", F.lit(0))
        for k, f in enumerate(frames[1:], 1):
            every = every.unionByName(f.withColumn("_k", F.lit(k)))
        rest = [c for c in frames[0].columns if c not in keys]
        by = F.col("_k") if first else -F.col("_k")
        row = every.groupBy(*keys).agg(F.min_by(F.struct(F.lit(0).alias("_"), *rest), by).alias("r"))
        return row.select(*keys, *[F.col("r")[c].alias(c) for c in rest])

    return pick(nodes, ["id"], True), pick(edges, ["src", "dst", "predicate", "g"], False)


def filtered(nodes: DataFrame, edges: DataFrame, center: str, types: list[str], predicates: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes(id, type) of the types and edges of the predicates between them; then the center and nodes that still have an edge."""
    allowed = nodes.where(F.col("type").isin(*types) | (F.col("id") == center))
    ends = allowed.select("id")
    kept = edges.where(F.col("predicate").isin(*predicates)).join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    touched = kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return allowed.where(F.col("id") == center).unionByName(allowed.where(F.col("id") != center).join(touched, "id", "left_semi")), kept


def bridges(edges: DataFrame, hits: DataFrame, least: int = 2) -> DataFrame:
    """(node, hits): nodes other than hits(node) that are next to at least this many of them."""
    near = both_ways(edges).select("node", "other").join(hits, "node").groupBy(F.col("other").alias("node")).agg(F.count_distinct("node").alias("hits"))
    return near.where(F.col("hits") >= least).join(hits, "node", "left_anti")


#: Classes whose instances can join two hits; those of others belong to one entity each.
CONNECTING = ("Ministry", "GovernmentOrgan", "AbolishedGovernmentOrgan", "Organization", "Law", "LawRevision", "BudgetProject", "UnresolvedReference")


def search_graph(edges: DataFrame, types: DataFrame, hits: DataFrame, connecting: tuple[str, ...] = CONNECTING, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a search: its hits(node), and of their neighbours those of a connecting type or next to at least this many hits.

    nodes(node, type, role, component): role is connected_hit, isolated_hit (no link is left), connecting or bridge; component is the least node that
    can be reached by links, which are the edges at a hit between nodes that stay.
    """
    hits = hits.select("node").distinct()
    one, two = (hits.select(F.col("node").alias(c), F.lit(True).alias(f"_{c}")) for c in ("src", "dst"))
    near = edges.join(small(one), "src", "left").join(small(two), "dst", "left").where("_src or _dst")
    neighbours = near.where("_src and _dst is null").select(F.col("dst").alias("node"), F.col("src").alias("hit")).unionByName(near.where("_dst and _src is null").select(F.col("src").alias("node"), F.col("dst").alias("hit")))
    counted = neighbours.groupBy("node").agg(F.count_distinct("hit").alias("hits")).join(types.select("node", "type"), "node", "left")
    kept = counted.where(F.col("type").isin(*connecting) | (F.col("hits") >= least)).select("node", "type", F.when(F.col("type").isin(*connecting), "connecting").otherwise("bridge").alias("role"))
    stays = kept.select("node").unionByName(hits)
    links = near.drop("_src", "_dst").join(stays.withColumnRenamed("node", "src"), "src", "left_semi").join(stays.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)
    ends = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("_linked", F.lit(True))
    own = hits.join(types.select("node", "type"), "node", "left").join(ends, "node", "left").select("node", "type", F.when(F.col("_linked"), "connected_hit").otherwise("isolated_hit").alias("role"))
    nodes = own.unionByName(kept)
    return nodes.join(least_reached(links, nodes), "node"), links


def least_reached(links: DataFrame, nodes: DataFrame, most: int = 1000) -> DataFrame:
    """(node, component): the least node of each one's component. Every round sends least nodes along links and then to the component of the least one
    found, so chains shorten as they grow; rounds are checkpointed and end when nothing changes."""
    both = cut(links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    now = cut(nodes.select("node", F.col("node").alias("component")).distinct())
    for _ in range(most):
        near = both.join(now.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("_near"))
        new = now.join(near, "node", "left").select("node", F.least("component", F.coalesce("_near", "component")).alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("_further"))
        new = cut(new.join(jump, "component", "left").select("node", F.least("component", F.coalesce("_further", "component")).alias("component")))
        if new.join(now, ["node", "component"], "left_anti").isEmpty():
            return now
        now = new
    raise ValueError(f"components still change after {most} rounds")


def lanes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id, type) with lane: who receives money by an edge recipient is a recipient, others go by type."""
    paid = edges.where("predicate = 'recipient'").select(F.col("dst").alias("id")).distinct().withColumn("_paid", F.lit(True))
    lane = F.when(F.col("type").isin("Ministry", "AbolishedGovernmentOrgan", "GovernmentOrgan"), "organ").when(F.col("type").isin("Law", "LawRevision"), "law").when(F.col("_paid"), "recipient")
    lane = lane.when(F.col("type").isin("BudgetProject", "AnnualBudget"), "project").when(F.col("type").isin("Expenditure", "ExpenditureBlock", "IndirectCost"), "expenditure").otherwise("other")
    return nodes.join(paid, "id", "left").withColumn("lane", lane).drop("_paid")
