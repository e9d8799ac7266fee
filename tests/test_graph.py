from __future__ import annotations

import random

import pytest

from ledgerweave.operators import graph as G

EDGE = "src string, dst string, predicate string, g string"


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, "p", "g") for a, b in pairs], EDGE)


def brute_hops(pairs, start):
    hops, todo = {start: 0}, [start]
    while todo:
        at = todo.pop(0)
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                if x == at and y not in hops:
                    hops[y] = hops[at] + 1
                    todo.append(y)
    return hops


@pytest.fixture(scope="module")
def pairs():
    r = random.Random(4)
    return sorted({(f"n{r.randint(0, 40):02d}", f"n{r.randint(0, 40):02d}") for _ in range(60)})


def test_hops_and_paths_agree_with_a_search(spark, pairs):
    edges = frame(spark, pairs)
    want = brute_hops(pairs, "n00")
    start = spark.createDataFrame([("n00",)], "node string")
    got = {r["node"]: r["hops"] for r in G.hops_from(edges, start, 3).collect()}
    assert got == {n: h for n, h in want.items() if h <= 3}
    far = max(want, key=lambda n: (want[n] <= 4) * want[n])
    path = G.find_path(edges, "n00", far, 6, 2000, 200)
    assert path.found and len(path.edges) == want[far] and path.nodes[0] == "n00" and path.nodes[-1] == far
    for (a, b, _, _), x, y in zip(path.edges, path.nodes, path.nodes[1:]):
        assert {a, b} == {x, y}


def test_path_outcomes(spark):
    chain = frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y")])
    assert G.find_path(chain, "a", "a").nodes == ["a"]
    assert G.find_path(chain, "a", "x", max_depth=6).exhaustive
    limited = G.find_path(chain, "a", "e", max_depth=2)
    assert limited.depth_limited and not limited.found and not limited.exhaustive
    assert G.find_path(chain, "a", "e", visit_budget=2).budget_exhausted
    star = frame(spark, [("h", f"s{i}") for i in range(5)])
    assert G.find_path(star, "h", "z", fanout=2).fanout_truncated


def test_neighborhood_limits_leave_no_edge_without_ends(spark):
    edges = frame(spark, [("h", f"s{i}") for i in range(8)] + [("s0", "t"), ("s1", "s2")])
    full = G.neighborhood(edges, "h", 2)
    assert len(full.nodes) == 10 and len(full.edges) == 10 and not full.nodes_truncated
    small = G.neighborhood(edges, "h", 2, node_limit=4)
    assert small.nodes_truncated and {e for edge in small.edges for e in edge[:2]} <= set(small.nodes)
    assert G.neighborhood(edges, "h", 1, edge_limit=3).edges_truncated
    assert G.neighborhood(edges, "h", 1, fanout=2).fanout_truncated == ["h"]
    with pytest.raises(ValueError, match="depth"):
        G.neighborhood(edges, "h", 3)


def test_flow_levels_and_cycles(spark):
    links = spark.createDataFrame([("p", "A", "B"), ("p", "B", "C"), ("p", "A", "C")], "k string, src string, dst string")
    nodes = spark.createDataFrame([("p", x) for x in "ABC"], "k string, node string")
    assert {r["node"]: r["level"] for r in G.flow_levels(links, nodes, ["k"], 5).collect()} == {"A": 0, "B": 1, "C": 2}
    cycle = spark.createDataFrame([("p", "A", "B"), ("p", "B", "A")], "k string, src string, dst string")
    assert all(r["level"] <= 5 for r in G.flow_levels(cycle, nodes, ["k"], 5).collect())


def test_merge_filter_lanes(spark):
    a = spark.createDataFrame([("1", "first")], "id string, label string")
    b = spark.createDataFrame([("1", "second"), ("2", "x")], "id string, label string")
    ea = spark.createDataFrame([("1", "2", "p", "g", 1)], EDGE + ", w int")
    eb = spark.createDataFrame([("1", "2", "p", "g", 2)], EDGE + ", w int")
    nodes, edges = G.merged([a, b], [ea, eb])
    assert {tuple(r) for r in nodes.collect()} == {("1", "first"), ("2", "x")} and edges.first()["w"] == 2
    typed = spark.createDataFrame([("c", "Law"), ("o", "Organization"), ("m", "Ministry")], "id string, type string")
    links = spark.createDataFrame([("c", "m", "jurisdiction", "g"), ("e", "o", "recipient", "g")], EDGE)
    kept, kept_edges = G.filtered(typed, links, "c", ["Ministry"], ["jurisdiction"])
    assert {r["id"] for r in kept.collect()} == {"c", "m"} and kept_edges.count() == 1
    assert {r["id"]: r["lane"] for r in G.lanes(typed, links).collect()} == {"c": "law", "o": "recipient", "m": "organ"}
