from __future__ import annotations

import hashlib
import math
import random
import re
from zlib import crc32

import pytest

from ledgerweave.llm import resampling


def brute(rows, target, percent=10, least=20, longest=1):
    """What the contract says, row by row: (id, n_features, weight, score, rank)."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [crc32(" ".join(words[k : k + n]).encode()) % 10_000 for n in range(1, longest + 1) for k in range(len(words) - n + 1)]

    own, s, t = [features(text) for _, text in rows], [0] * 10_000, [0] * 10_000
    for _, found in own:
        for b in found:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    n, m = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((y + 1) * (n + 10_000) / ((x + 1) * (m + 10_000)))) for x, y in zip(s, t)]
    out = []
    for (i, _), (words, found) in zip(rows, own):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=repr)


def texts(seed, n):
    r = random.Random(seed)
    words = [f"Word{k}" for k in range(60)] + ["éa", "ÉA", "x1-y2", "don't", "日本", "_", "ZZ"]
    rows = [(k, r.choice([" ", "; ", "\n"]).join(r.choices(words, k=r.randint(0, 60)))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, " ".join(words * 2)), (n + 2, "éa " * 5000)], [" ".join(r.choices(words[20:40], k=15)) for _ in range(20)] + [None, ""]


def frames(spark, rows, target, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), spark.createDataFrame([(t,) for t in target], "text string")


def found(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("seed, percent, longest", [(1, 10, 1), (2, 100, 1), (3, 50, 3), (4, 0, 2)])
def test_against_brute_force(spark, seed, percent, longest):
    rows, target = texts(seed, 200)
    got = resampling.resampled(*frames(spark, rows, target), percent=percent, longest=longest)
    assert found(got) == brute(rows, target, percent, longest=longest)


@pytest.mark.parametrize("run, chunk, merged", [(7, 3, 5), (1000, 1, 1), (11, 100, 40)])
def test_runs_chunks_and_ranges_of_any_size(spark, monkeypatch, run, chunk, merged):
    for name, value in (("RUN", run), ("CHUNK", chunk), ("MERGED", merged)):
        monkeypatch.setattr(resampling, name, value)
    rows, target = texts(5, 150)
    assert found(resampling.resampled(*frames(spark, rows, target, 7), percent=37)) == brute(rows, target, 37)


def test_what_is_not_drawn_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(resampling, "MERGED", 10)
    seen, merged = {}, resampling._merged
    monkeypatch.setattr(resampling, "_merged", lambda chunks, quota: seen.update(ranges={r["range"] for r in chunks.select("range").distinct().collect()}, quota=quota) or merged(chunks, quota))
    rows, target = texts(6, 200)
    assert found(resampling.resampled(*frames(spark, rows, target))) == brute(rows, target)
    assert seen["ranges"] == {k for k, (n, _) in seen["quota"].items() if n} and sum(n for n, _ in seen["quota"].values()) == sum(1 for x in brute(rows, target) if x[4])


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c " * 10)] * 8 + [(2, "d " * 30)] * 2
    got = resampling.resampled(*frames(spark, rows, ["a"]), percent=40)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == [1, 2, 3, 4] and got.count() == 10
    assert resampling.resampled(*frames(spark, [], ["a"])).count() == 0
    assert found(resampling.resampled(*frames(spark, rows[:1] + rows[8:9], []), percent=50)) == brute(rows[:1] + rows[8:9], [], 50)
    with pytest.raises(ValueError):
        resampling.resampled(*frames(spark, rows, []), percent=101)


def test_tournament():
    r = random.Random(2)
    runs = [sorted(r.sample(range(10_000), r.randint(0, 30))) for _ in range(13)]
    tree, out = resampling.Tournament(), []
    for k, run in enumerate(runs):
        tree.add(iter([(x, k) for x in run]))
    while tree.least() is not None:
        out.append(tree.take())
    assert out == sorted((x, k) for k, run in enumerate(runs) for x in run)
