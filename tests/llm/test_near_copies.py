"""Near copies against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from ledgerweave.llm import near_copies


def brute_kept(rows, words=5, least=0.8):
    """Ids that stay of rows (doc_id, text): all pairs compared."""

    def shingles(text):
        found = (text or "").lower().split()
        return frozenset(" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()

    sets = [shingles(t) for _, t in rows]
    root = [*range(len(rows))]
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and (a == sets[j] or len(a & sets[j]) / len(a | sets[j]) >= least):
                gone, to = root[i], root[j]
                root = [to if r == gone else r for r in root]
    return sorted(min(rows[j][0] for j in range(len(rows)) if root[j] == r) for r in {*root})


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def kept(found):
    return sorted(r["doc_id"] for r in found.collect())


@pytest.mark.parametrize("cell, group", [(1024, 16384), (4, 50), (1, 1000)])
def test_made_texts(spark, monkeypatch, cell, group):
    monkeypatch.setattr(near_copies, "CELL", cell)
    monkeypatch.setattr(near_copies, "GROUP", group)
    r = random.Random(4)
    line = " ".join(f"c{i}" for i in range(40))
    rows = [(0, ""), (1, None), (2, "One two"), (3, "one  TWO"), (4, "one two three")]
    for _ in range(25):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(6, 160))]
        for _ in range(r.randint(1, 7)):
            own = [*base]
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = f"x{r.randrange(900)}"
            rows.append((len(rows), " ".join(own[: len(own) - r.randint(0, 4)]) + (f" {line}" if r.random() < 0.4 else "")))
    assert kept(near_copies.keep_one(frame(spark, rows))) == brute_kept(rows)


def test_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert kept(corpus_pipeline.drop_near_copies(spark, docs, sf_dir)) == brute_kept(rows)


def test_columns_of_any_names_stay(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", 7, 8, 9, "x"), (2, "a b c d e f", 1, 1, 1, "y"), (2, "a b c d e f", 1, 1, 1, "y")], "doc_id long, text string, _id int, node int, _again int, fp string")
    assert [tuple(r) for r in near_copies.keep_one(docs).collect()] == [(2, "a b c d e f", 1, 1, 1, "y")]
