from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import repeats


def brute(rows, length=200):
    number = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        number.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if number[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(frame):
    rows = repeats.repeats_removed(frame).collect()
    return sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows], key=repr)


def texts(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    base = [" ".join(word() for _ in range(r.randint(5, 400))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(n):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 8)):
            t[r.randrange(len(t))] = r.choice("xyz ")
        a, b = sorted(r.sample(range(len(t) + 1), 2))
        rows.append((1000 + k, "".join(t) if k % 2 else r.choice(base)[:50] + "".join(t[a:b]) + r.choice(base)[-90:]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = texts(seed, 40)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, "a" * 3000), (2, "ab" * 400), (3, None), (4, ""), (5, "q" * 199), (6, "q" * 200), (None, "one two " * 40), (7, "one two " * 40), (7, "one two " * 40), (8, "é" * 300), (9, "z" * 200), (10, "y" * 201)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert repeats.repeats_removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_longer_than_a_piece(spark):
    r = random.Random(9)
    noise = lambda n: "".join(r.choices("abcdefghijklmnop ", k=n))
    passage = noise(700)
    cut = repeats.PIECE - 350
    rows = [(1, noise(cut) + passage + noise(repeats.PIECE)), (2, noise(1000) + passage + noise(50))]
    got = {x[0]: x for x in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1][2] == got[2][2] == 700 and got[1][3] == 1


def test_intervals_partition_the_windows():
    text = np.frombuffer(("abc " * 500 + "".join(random.Random(1).choices("xyz", k=5000))).encode(), np.uint8)
    windows = [w for _, _, a, lo, hi in repeats._anchored(text, 200) for x, y, z in zip(a, lo, hi) for w in range(x + y, x + z + 1)]
    assert windows == list(range(len(text) - 199))


def test_keep_rest_keeps_columns_and_cuts_characters_whole(spark):
    docs = spark.createDataFrame([(1, "p" + "é" * 150, "x", 0), (2, "r" + "é" * 150, "y", 0), (3, "short", "z", 0), (4, None, "n", 0)], "doc_id long, text string, kd string, n_chars long")
    got = {r["doc_id"]: r for r in repeats.keep_rest(docs).collect()}
    assert [got[k]["text"] for k in (1, 2, 3, 4)] == ["p", "r", "short", None] and got[1]["kd"] == "x" and got[1]["n_chars"] == 1


def test_windows_too_long_to_pack_raise(spark):
    docs = spark.createDataFrame([(1, "a" * 2000)], "doc_id long, text string")
    with pytest.raises(ValueError, match="544 at most"):
        repeats.repeats_removed(docs, min_bytes=545)
    assert repeats.repeats_removed(docs, min_bytes=544).first()["n_removed"] == 2000


def test_columns_of_any_names_stay(spark):
    text = "q w e " * 60
    docs = spark.createDataFrame([(1, text, 7, 8, 9, 0), (2, text, 1, 2, 3, 0), (-(2**63), "short", 4, 5, 6, 0), (None, None, 4, 5, 6, 0)], "doc_id long, text string, _kd int, kt int, _ranges int, n_chars long")
    rows = {tuple(r) for r in repeats.keep_rest(docs).collect()}
    assert rows == {(2, "", 1, 2, 3, 0), (-(2**63), "short", 4, 5, 6, 5), (None, None, 4, 5, 6, None), (1, "", 7, 8, 9, 0)}
    assert {r["doc_id"] for r in repeats.repeats_removed(docs).collect()} == {1, 2, -(2**63), None}


def test_lengths_double_up_to_the_last_two():
    assert repeats._lengths(200) == [32, 64, 128, 193, 200] and repeats._lengths(40) == [32, 33, 40] and repeats._lengths(544) == [32, 64, 128, 256, 512, 537, 544]


@pytest.mark.parametrize("length", [40, 75, 300])
def test_other_lengths_against_brute_force(spark, length):
    rows = texts(5, 25)
    got = repeats.repeats_removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_bytes=length).collect()
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got], key=repr) == brute(rows, length)


def test_heavy_anchors_are_spread_by_what_follows(spark, monkeypatch):
    """A common line before different texts: its anchors skip the short lengths, with the same result."""
    monkeypatch.setattr(repeats, "FEW", 100)
    r = random.Random(4)
    noise = lambda n: "".join(r.choices("abcdefghijklmnop ", k=n))
    line = "-" * 20 + " the same line stands before all of these texts " + "=" * 60
    rows = [(k, line + noise(150 + k % 90)) for k in range(400)] + [(1000 + k, noise(30) + line * 3 + noise(40)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = repeats._keyed(docs, "doc_id", "text")
    heavy = repeats._heavy(keyed, 200)
    assert len(heavy)
    first = repeats._first_round(keyed, 200, heavy)
    rows_of = first.groupBy("rank", "beyond").count()
    assert rows_of.agg({"count": "max"}).first()[0] < 100
    assert found(docs) == brute(rows)


def test_all_rounds_read_one_shuffle_of_the_texts(spark):
    docs = spark.createDataFrame(texts(3, 20), "doc_id long, text string").withColumn("source", F.lit("a")).repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = repeats.keep_rest(docs)
        kept.collect()
        plan = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    reused = [x for x in plan.splitlines() if "ReusedExchange" in x and "hashpartitioning(kd" in x and "text#" in x]
    assert len(reused) == 4
