from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerweave.llm import components, simhash


def plain_fingerprint(text):
    words = text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "  \n", "One", "One two", "A b C d e", "a b c a b c a b c", "x\x0by\x1cz é É", "w " * 5000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def brute_components(fps, budget=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(a ^ b).count("1") <= budget and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_forest_connects_what_links_connect(seed):
    r = random.Random(seed)
    centers = [r.getrandbits(64) for _ in range(5)]
    fps = sorted({c ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) & (1 << 64) - 1 for c in centers for _ in range(30)} | {r.getrandbits(64) for _ in range(30)})
    want = brute_components(fps)
    u, v = simhash.forest(a := np.array(fps, np.uint64), a, 0, 3)
    links = [(int(x), int(y)) for x, y in zip(u, v)]
    assert all(bin(x ^ y).count("1") <= 64 for x, y in links) and len(links) == len(fps) - len({*want.values()})
    assert {f: min(g for g in fps if want[g] == want[f]) for f in fps} == want
    assert all(want[x] == want[y] for x, y in links)


def test_dense_group_gives_a_forest_only():
    near = np.unique(np.array([(1 << 40) ^ (1 << i) ^ (1 << j) for i in range(60) for j in range(60)], np.uint64))
    u, _ = simhash.forest(near, near, 0, 3)
    assert len(u) == len(near) - 1


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and got[101] == got[103] == 100 and 200 not in got
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


ROWS = [(1, "a b c d"), (2, "A b  c\nd"), (2, "A b  c\nd"), (3, "q w e r t"), (3, "q w e r t"), (None, None), (None, ""), (5, "x1 y2 z3"), (5, "other words here now"), (6, "long " * 20000)]


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "z") for r in ROWS], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert {r["component_id"] for r in got if r["doc_id"] == 2} == {1}
    assert [r["fingerprint"] for r in got if r["doc_id"] is None] == ["0" * 16] * 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:7]) for r in kept.collect()) == [(0, ""), (1, "a b c d"), (3, "q w e r"), (5, "other w"), (5, "x1 y2 z"), (6, "long lo")]


def test_query_against_brute_force(spark, sf_dir):
    from ledgerweave.llm.queries import QUERIES

    got = QUERIES["op1_simhash_near_dedup"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    fp = {int(i): simhash.fingerprint(t) for i, t in zip(docs.doc_id, docs.text)}
    want = brute_components(sorted({*fp.values()}))
    least = {}
    for i, f in fp.items():
        least[want[f]] = min(i, least.get(want[f], i))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got.itertuples()} == {(i, f"{f:016x}", least[want[f]]) for i, f in fp.items()}


@pytest.mark.parametrize("cell_rows, budget", [(16_384, 3), (40, 3), (3, 3), (1, 3), (3, 2), (5, 0)])
def test_links_across_cells_dealt_again_and_again(spark, monkeypatch, cell_rows, budget):
    """Cells down to the last level: centres, and others that share most of the bits of one, so that bands are hot."""
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    r = random.Random(cell_rows)
    flip = lambda x, k: x ^ sum(1 << b for b in r.sample(range(64), k))
    centers = [r.getrandbits(64) for _ in range(4)]
    fps = sorted({flip(c, r.randint(0, 4)) for c in centers for _ in range(40)} | {centers[0] ^ r.getrandbits(18) for _ in range(150)} | {r.getrandbits(64) for _ in range(40)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = brute_components(fps, budget)
    links = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.trie_links(spark.createDataFrame(signed, "fp long"), budget).collect()]
    assert all(want[u] == want[v] for u, v in links)
    root = {f: f for f in fps}
    for _ in fps:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    assert root == want


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_near_pairs_are_all_pairs_within_the_budget(seed):
    r = random.Random(seed)
    runs, fp = [], []
    for _ in range(6):
        c = r.getrandbits(64)
        own = sorted(c ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 9))) & (1 << 64) - 1 if r.random() < 0.7 else r.getrandbits(64) for _ in range(r.randint(1, 40)))
        runs.append((len(fp), len(fp) + len(own)))
        fp += own
    budget = r.choice([0, 3, 14, 24])
    i, j = simhash.near_pairs(np.array(fp, np.uint64), *(np.array(x) for x in zip(*runs)), budget)
    want = {(x, y) for a, b in runs for x in range(a, b) for y in range(x + 1, b) if bin(fp[x] ^ fp[y]).count("1") <= budget}
    assert len(i) == len(want) and {(int(x), int(y)) for x, y in zip(i, j)} == want
    group = np.array([r.randrange(5) + 10 * next(k for k, (a, b) in enumerate(runs) if a <= x < b) for x in range(len(fp))])
    i, j = simhash.near_pairs(np.array(fp, np.uint64), *(np.array(x) for x in zip(*runs)), budget, group)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted((x, y) for x, y in want if group[x] != group[y])
    i, j = simhash.near_pairs(np.array(fp, np.uint64), *(np.array(x) for x in zip(*runs)), budget, np.arange(len(fp)), True)
    chosen = {(int(x), int(y)) for x, y in zip(i, j)}

    def parts(pairs):
        root = [*range(len(fp))]
        for x, y in pairs:
            if root[x] != root[y]:
                gone, to = root[y], root[x]
                root = [to if z == gone else z for z in root]
        return {frozenset(k for k, z in enumerate(root) if z == y) for y in root}

    assert chosen <= want and parts(chosen) == parts(want) and len(chosen) == len(fp) - len(parts(want))


def test_columns_of_any_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, 8, 9, True, "k"), (2, "a b c d", 1, 1, 1, False, "l")], "doc_id long, text string, _id int, none int, _kt int, again boolean, KEY string")
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == [(1, "a b c d", 7, 8, 9, True, "k")]
