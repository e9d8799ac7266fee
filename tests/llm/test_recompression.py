from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import recompression


def brute(rows, window=20):
    """What the contract says, over rows (id, text) of different ids."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        out.append((i, len(words), sum(gone), b" ".join(x for x, g in zip(words, gone) if not g).decode()))
    return out


def found(frame, window=20):
    return sorted(map(tuple, recompression.passages_removed(frame, window=window).collect()))


def texts(seed, n, words="abcdefgh"):
    r = random.Random(seed)
    base = [[r.choice(words) for _ in range(r.randint(0, 150))] for _ in range(n)]
    shared = [[r.choice(words) for _ in range(40)] for _ in range(3)]
    rows = []
    for k in range(3 * n):
        t = list(r.choice(base)) if k % 2 else r.choice(base)[:30] + r.choice(shared) + r.choice(base)[-30:]
        for _ in range(r.randint(0, 3)):
            t.insert(r.randint(0, len(t)), r.choice(["x", "y", "a a a a", "é"]))
        if k % 7 == 0:
            t += [r.choice(words)] * r.randint(1, 70) + ["a", "b"] * r.randint(1, 30)
        rows.append((k, r.choice([" ", "  ", "\t", "\n"]).join(t)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, window", [(1, 20), (2, 20), (3, 7), (4, 50)])
def test_against_brute_force(spark, seed, window):
    rows = texts(seed, 40)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window) == brute(rows, window)


def test_heavy_names_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(recompression, "FEW", 2)
    monkeypatch.setattr(recompression, "HEAVY", 0)
    rows = texts(5, 30)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_texts_longer_than_a_block_and_a_piece(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(50_000)}" for _ in range(recompression.BLOCK + 500)]
    long = " ".join(words[:1000] * 2 + words + words[-30:] + ["same"] * 100)
    huge = " ".join(r.choices(words, k=700_000)) + " " + " ".join(words[recompression.BLOCK - 40 : recompression.BLOCK + 60])
    assert len(huge) > recompression.BYTES
    rows = [(5, long), (6, " ".join(words[recompression.BLOCK - 30 : recompression.BLOCK + 30])), (7, "z" * 100), (8, huge)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_odd_rows(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(1, passage), (1, passage), (2, None), (3, ""), (4, " \t\n "), (None, passage + " more"), (6, passage), (7, " ".join(passage.split()[:19])), (8, "x\u00a0y " * 30)]
    got = {}
    for i, n, gone, kept in recompression.passages_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(i, []).append((n, gone, kept))
    # a null id counts as 0, so it is first; repeated rows are one document
    assert got[None] == [(26, 0, passage + " more")] and got[1] == [(25, 25, "")] * 2 and got[6] == [(25, 25, "")]
    assert got[2] == got[3] == got[4] == [(0, 0, "")] and got[7] == [(19, 0, " ".join(passage.split()[:19]))]
    assert got[8] == [(30, 29, "x\u00a0y")]
    assert recompression.passages_removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        recompression.passages_removed(spark.createDataFrame(rows, "doc_id long, text string"), window=3)


def test_rows_alike_in_id_and_text_are_one_document(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = spark.createDataFrame([(1, passage)] * 2 + [(2, passage)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in recompression.passages_removed(rows).collect()) == [0, 0, 25]


def test_rest_keeps_columns_of_any_names(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    docs = spark.createDataFrame([(1, passage, "a", 5), (2, "new " + passage, "b", 6), (3, None, None, 7)], "doc_id long, text string, `kd` string, `x.y` int")
    kept = recompression.keep_rest(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(1, passage, "a", 5), (2, "new", "b", 6), (3, None, None, 7)]


def test_equal_passages_have_equal_symbols_inside():
    r = np.random.default_rng(1)
    passage = r.integers(0, 50, 60).astype(np.uint64)
    one, two = (np.concatenate([r.integers(0, 50, n).astype(np.uint64), passage, r.integers(0, 50, n).astype(np.uint64)]) for n in (30, 77))
    for level, (a, b) in enumerate(zip(recompression._levels(one), recompression._levels(two))):
        inside = [{(n, s - at, e - at) for n, s, e in zip(*(x.tolist() for x in symbols)) if s >= at and e <= at + 60} for symbols, at in ((a, 30), (b, 77))]
        assert inside[0] == inside[1]
        if level < 3:
            assert inside[0]


def test_many_copies_send_few_rows(spark):
    passage = " ".join(f"p{k}" for k in range(500))
    docs = spark.createDataFrame([(k, passage) for k in range(300)], "doc_id long, text string").repartition(4)
    keyed = docs.select(F.col("doc_id").alias("kd"), F.xxhash64("text").alias("kt"), "text")
    rows = recompression._first_round(keyed, 20)
    assert rows.where("not known").count() < 4 * 200
