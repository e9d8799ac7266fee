"""Digest trees, the N-Quads sink and release tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import digest_tree
from ledgerweave.sources import nquads_sink


def lines(spark, spec):
    made = [spark.range(n).select(F.lit(g).alias("g"), F.concat(F.lit(f"{tag} "), F.col("id").cast("string")).alias("value")) for g, tag, n in spec]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def brute(old, new):
    a, b = ({(r["g"], r["value"]) for r in x.collect()} for x in (old, new))
    return sorted([(*x, "removed") for x in a - b] + [(*x, "added") for x in b - a])


def found(frame):
    return sorted(map(tuple, frame.select("g", "value", "change").collect()))


def test_changed_lines_are_found_from_the_root_down(spark, tmp_path):
    old = lines(spark, [("big", "x", 6000), ("small", "x", 3), ("gone", "x", 20), ("same", "x", 500)])
    new = lines(spark, [("big", "x", 6000), ("small", "x", 4), ("new", "x", 7), ("same", "x", 500)]).where("value not in ('x 17', 'x 4000') or g <> 'big'").unionByName(lines(spark, [("big", "y", 1)]))
    for name, rows in (("a", old), ("b", new)):
        digest_tree.save(rows, str(tmp_path / name), leaf=16)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert found(digest_tree.changed_lines(spark, a, b)) == brute(old, new)
    leaves = digest_tree.unequal_leaves(spark, a, b)
    of_big = leaves.where("g = 'big'").collect()
    assert len(of_big) == 3 and all(len(r["prefix"]) == 3 for r in of_big) and leaves.where("g = 'same'").isEmpty()
    assert found(digest_tree.changed_lines(spark, a, a)) == []
    assert {r["g"]: r["n"] for r in digest_tree.roots(spark, a).collect()} == {"big": 6000, "small": 3, "gone": 20, "same": 500}


def test_trees_of_other_depths_compare(spark, tmp_path):
    old, new = lines(spark, [("g", "x", 10)]), lines(spark, [("g", "x", 3000)])
    for name, rows in (("a", old), ("b", new), ("c", new.repartition(7))):
        digest_tree.save(rows, str(tmp_path / name), leaf=8)
    a, b, c = (str(tmp_path / x) for x in "abc")
    assert found(digest_tree.changed_lines(spark, a, b)) == brute(old, new) and found(digest_tree.changed_lines(spark, b, c)) == []


def test_only_folders_with_differences_are_read(spark, tmp_path):
    old = lines(spark, [("g", "x", 6000)])
    new = old.where("value <> 'x 5'")
    for name, rows in (("a", old), ("b", new)):
        digest_tree.save(rows, str(tmp_path / name), leaf=8)
    changed = digest_tree.changed_lines(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert found(changed) == [("g", "x 5", "removed")]
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [(shard" in plan


def test_a_release_of_files_with_its_manifest(spark, tmp_path):
    spark.dataSource.register(nquads_sink.NQuadsSink)
    rows = lines(spark, [("g1", "x", 100), ("g2", "y", 7)]).select("g", F.concat("value", F.lit(" <"), "g", F.lit("> .")).alias("value"))
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    rows.repartition(5).write.format("nquads").option("path", one).option("notes", "first").mode("append").save()
    rows.repartition(2).write.format("nquads").option("path", two).mode("append").save()
    said = nquads_sink.manifest(one)
    assert {g: x["n"] for g, x in said["graphs"].items()} == {"g1": 100, "g2": 7} and said["notes"] == "first" and said["graphs"] == nquads_sink.manifest(two)["graphs"]
    assert sorted(os.listdir(one)) == sorted([f["name"] for f in said["files"]] + ["manifest.json"])
    assert sorted(map(tuple, nquads_sink.read(spark, one).collect())) == sorted(map(tuple, rows.collect())) and nquads_sink.differing(spark, one) == []
    with pytest.raises(Exception, match="has a manifest"):
        rows.write.format("nquads").option("path", one).mode("append").save()
    name = said["files"][0]["name"]
    import gzip

    with gzip.open(f"{one}/{name}", "ab") as f:
        f.write(b"z <g2> .\n")
    assert nquads_sink.differing(spark, one) == ["g2", name]


def test_a_failed_release_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(nquads_sink.NQuadsSink)
    rows = lines(spark, [("g", "x", 1000)]).repartition(4).withColumn("value", F.when(F.col("value") == "x 700", F.raise_error(F.lit("stopped")).cast("string")).otherwise(F.col("value")))
    folder = str(tmp_path / "out")
    with pytest.raises(Exception):
        rows.write.format("nquads").option("path", folder).mode("append").save()
    assert not os.path.exists(folder) or os.listdir(folder) == []
