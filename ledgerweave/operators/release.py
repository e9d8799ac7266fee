"""Releases of named graphs: digests, differences, carry-over of unchanged graphs, and replacement by graph."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES
from . import pointer
from .quads import line


def graph_digests(lines: DataFrame) -> DataFrame:
    """(g, n, digest) for lines(g, value), in any order: SHA-256 over the digests of parts, these over the digests of theirs, and so on down to lines.

    A line's part is told by the first digits of its own digest, so no row holds more than 256 parts, or the lines of one part of 16 million. Parts that
    differ are named by digest_tree.
    """
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    d = lines.select("g", F.sha2("value", 256).alias("d"))
    made = d.groupBy("g", F.substring("d", 1, 6).alias("part")).agg(F.count("*").alias("n"), joined("d").alias("d"))
    for digits in (4, 2):
        made = made.groupBy("g", F.substring("part", 1, digits).alias("part")).agg(F.sum("n").alias("n"), joined(F.concat_ws(" ", "part", "d")).alias("d"))
    return made.groupBy("g").agg(F.sum("n").alias("n"), joined(F.concat_ws(" ", "part", "d")).alias("digest"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(g, change) for digests of two releases: added, removed, changed or same."""
    joined = old.select("g", F.col("digest").alias("_a")).join(new.select("g", F.col("digest").alias("_b")), "g", "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return joined.select("g", change.alias("change"))


def undeclared(quads: DataFrame, declared: DataFrame) -> DataFrame:
    """Quads of graphs that no manifest declares."""
    return quads.join(declared.select("g").distinct(), "g", "left_anti")


def carried_over(now: DataFrame, before: DataFrame, needs: DataFrame, shipped: DataFrame) -> DataFrame:
    """(source, carried, previous_date) of sources whose graph may be taken from the previous release.

    now and before(source, date, sha256 array) hold files by source; needs(source, needed) names the sources that a graph depends on, itself
    included. A graph is carried over if all of them are unchanged and the previous release shipped it intact: shipped(source, intact).
    """
    files = lambda x: F.sort_array(x)
    same = now.select("source", files(F.col("sha256")).alias("_a")).join(before.select("source", "date", files(F.col("sha256")).alias("_b")), "source", "left").withColumn("_same", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)))
    alike = needs.join(same.select(F.col("source").alias("needed"), "_same"), "needed", "left").groupBy("source").agg(F.min(F.coalesce("_same", F.lit(False))).alias("_all"))
    rows = same.join(alike, "source", "left").join(shipped, "source", "left")
    carried = F.coalesce("_all", F.col("_same")) & F.coalesce("intact", F.lit(False))
    return rows.select("source", carried.alias("carried"), F.when(carried, F.col("date")).alias("previous_date"))


def replace_graphs(quads: DataFrame, path: str) -> None:
    """Writes quads over the graphs they hold; other graphs in path stay. Corrections and deletions need no special case."""
    quads.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("g").parquet(path)


def manifest(quads: DataFrame) -> DataFrame:
    """(g, n, digest) as a release's manifest holds it."""
    return graph_digests(quads.select("g", line().alias("value")))


def verify(quads: DataFrame, declared: DataFrame) -> DataFrame:
    """Graphs whose number or digest isn't the declared one, or that only one side has."""
    found = manifest(quads).withColumnsRenamed({"n": "n_found", "digest": "digest_found"})
    joined = declared.join(found, "g", "full_outer")
    return joined.where(~(F.col("n").eqNullSafe(F.col("n_found")) & F.col("digest").eqNullSafe(F.col("digest_found"))))


def multi_valued(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value, for stability between years."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.count("*").alias("n_rows")).where("n_values > 1")


def stage(quads: DataFrame, declared: DataFrame, root: str, keep: int = 2) -> str:
    """Checks quads against their manifest, writes them as a version of their own, and then points to it; returns the version's name.

    Readers follow the pointer, which moves at once, so there is always a release to read; anything wrong raises before it moves. The
    last keep versions stay for readers that are at them and for rollback.
    """
    spark = quads.sparkSession
    if not verify(quads, declared).isEmpty():
        raise ValueError("the quads aren't what the manifest declares")
    before = pointer.latest(spark, f"{root}/release") or {"now": None, "before": []}
    version = uuid4().hex
    replace_graphs(quads, f"{root}/versions/{version}")
    past = [*([before["now"]] if before["now"] else []), *before["before"]]
    pointer.advance(spark, f"{root}/release", {"now": version, "before": past})
    for old in past[keep - 1 :]:
        pointer.remove(spark, f"{root}/versions/{old}")
    return version


def served(spark: SparkSession, root: str) -> DataFrame:
    """The quads of the release that the pointer names."""
    now = pointer.latest(spark, f"{root}/release")
    if now is None:
        raise FileNotFoundError(f"no release at {root}")
    return spark.read.schema(TABLES["quads"]).parquet(f"{root}/versions/{now['now']}")


def rollback(spark: SparkSession, root: str) -> str:
    """Points to the version before, by one write; raises if there is none any more."""
    now = pointer.latest(spark, f"{root}/release")
    if not now or not now["before"] or not pointer.exists(spark, f"{root}/versions/{now['before'][0]}"):
        raise FileNotFoundError(f"no earlier release at {root}")
    pointer.advance(spark, f"{root}/release", {"now": now["before"][0], "before": now["before"][1:]})
    return now["before"][0]


def publish(quads: DataFrame, folder: str) -> None:
    """Gzipped lines of N-Quads, with the digest of the lines of each graph beside them."""
    lines = quads.select("g", line().alias("value"))
    lines.select("value").write.mode("errorifexists").option("compression", "gzip").text(f"{folder}/lines")
    graph_digests(lines).coalesce(1).write.mode("errorifexists").json(f"{folder}/digests")


def published_is_intact(spark, folder: str) -> bool:
    """Whether published lines have the digests that are beside them."""
    lines = spark.read.text(f"{folder}/lines").select(F.regexp_extract("value", r" <([^>]*)> \.$", 1).alias("g"), "value")
    declared = spark.read.json(f"{folder}/digests").select("g", F.col("n").cast("bigint").alias("n"), "digest")
    found = graph_digests(lines)
    return found.exceptAll(declared).isEmpty() and declared.exceptAll(found).isEmpty()


def safe_name(c):
    """A graph's address as the name of a file."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")
