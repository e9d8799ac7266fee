from __future__ import annotations

import numpy as np
import pytest

from ledgerweave.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, every, k):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], 0) for i, row in zip(ids, x)], SCHEMA)


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(3)
    x = r.standard_normal((9000, 12)).astype(np.float32) * r.uniform(0.2, 3, (9000, 1)).astype(np.float32)
    x[:3000] = x[5]  # a third of all rows
    return np.arange(9000) * 1, x


def test_exact_search(spark, data):
    ids, x = data
    rows = vectors.exact_top_k(table(spark, ids, x), every=900).collect()
    want = brute(ids, np.floor(1024 * x.astype(np.float64)), 900, 10)
    assert grouped(rows) == want and {r["rank"] for r in rows} == set(range(1, 11))


def test_exact_search_in_several_cells_and_blocks(spark, data, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP", 700)
    monkeypatch.setattr(vectors, "CELL", 500)
    ids, x = data
    rows = vectors.exact_top_k(table(spark, ids, x), every=11, k=3)
    assert grouped(rows.collect()) == brute(ids, np.floor(1024 * x.astype(np.float64)), 11, 3)


def test_recall_of_approximate_search(spark, data, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 500)
    ids, x = data[0][3000:], data[1][3000:]
    got = grouped(vectors.near_top_k(table(spark, ids, x), every=200).collect())
    want = brute(ids, x.astype(np.float64), 200, 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, rows in got.items():
        assert all(abs(s - float(x[i - 3000].astype(np.float64) @ x[q - 3000].astype(np.float64))) < 1e-9 for i, s in rows)


def test_chi_square_quantile():
    assert abs(vectors.chi_square_quantile(0.95, 2) - 5.991) < 1e-3 and abs(vectors.chi_square_quantile(0.99, 8) - 20.090) < 1e-3


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, None, 0), (3, [nan, 1.0], 0), (4, [inf, 0.0], 0), (5, [None, 1.0], 0), (6, [], 0), (7, [0.0, 0.0], 0), (8, [0.5, 0.5], 0), (9, [2.0], 0), (None, [1.0, 1.0], 0), (8, [0.5, 0.5], 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    exact = grouped(vectors.exact_top_k(frame).collect())
    assert exact == {0: [(9, 2048 * 1024), (1, 512 * 1024), (8, 512 * 1024), (8, 512 * 1024), (7, 0)]}
    near = grouped(vectors.near_top_k(frame).collect())
    assert near == {0: [(9, 2.0), (1, 0.5), (8, 0.5), (8, 0.5)]}
    assert vectors.exact_top_k(frame.limit(0)).count() == 0 and vectors.near_top_k(frame.where("vec_id = 0")).count() == 0


def test_scores_that_are_too_large_raise(spark):
    with pytest.raises(Exception, match="2\\^53"):
        vectors.exact_top_k(table(spark, [0, 1], [[3e7], [3e7]])).collect()


def test_candidates_are_sent_once_for_each_block_of_queries_of_their_cell(spark, data, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP", 200)
    monkeypatch.setattr(vectors, "CELL", 500)
    ids, x = data[0][3000:], data[1][3000:]
    rows = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, vec array<double>")
    for every in (40, 10):  # 150 and 600 queries of 6000 rows
        sent: list[int] = []
        vectors.search(rows, every, 3, vectors.Rings, sent)
        cells = 1 << round(np.log2(6000 / 500))
        blocks = -(-6000 // every // 200) + 1  # of all queries, if all go to one cell
        assert sent[0] <= 6000 * blocks and all(n <= 6000 * blocks for n in sent) and len(sent) <= cells.bit_length()
        if every == 40:
            assert all(n <= 6000 for n in sent)  # one block: each candidate once a round at most


def test_recall_on_the_querys_own_table(spark, sf_dir):
    from ledgerweave.llm.queries import QUERIES

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x, ids = np.array(table.embedding.tolist(), np.float64), table.vec_id.to_numpy()
    got = grouped(QUERIES["op4_stable_projection_ann"](spark, sf_dir).collect())
    want = brute(ids, x, 20, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
