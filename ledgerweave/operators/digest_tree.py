"""Digest trees of graphs: as deep as a graph is large, so that two releases are compared from the root down and only where they differ.

A line's place is the digest of it, so lines spread evenly. A leaf holds the lines whose digests begin alike, some LEAF of them; a node holds the digest of its up to 16
children. save writes nodes by level and lines by the first two digits of their places; a comparison reads the levels' unequal nodes, and of the lines
only folders and leaves in which something differs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut
from .resolve import small

LEAF, DEEPEST = 1024, 12
NODES = "g string, prefix string, leaf boolean, n bigint, digest string, level int"
LINES = "g string, place string, value string, shard string"


def _placed(lines: DataFrame, leaf: int) -> DataFrame:
    """(g, value, place, depth): every line once, with the depth of its graph's tree."""
    rows = lines.select("g", "value").distinct().withColumn("place", F.sha2("value", 256))
    sizes = rows.groupBy("g").agg(F.least(F.lit(DEEPEST), F.greatest(F.lit(0), F.ceil(F.log(16.0, F.count("*") / leaf)))).cast("int").alias("depth"))
    return rows.join(sizes, "g")


def _joined(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), "\n"), 256)


def nodes(placed: DataFrame) -> DataFrame:
    """All nodes, of leaves upwards: one aggregation for each level, of a sixteenth of the rows of the one below."""
    leaves = placed.groupBy("g", F.expr("left(place, depth)").alias("prefix"), F.col("depth").alias("level")).agg(F.count("*").alias("n"), _joined(F.col("place")).alias("digest")).withColumn("leaf", F.lit(True))
    leaves = cut(leaves.select("g", "prefix", "leaf", "n", "digest", "level"))
    deepest = leaves.agg(F.max("level")).first()[0] or 0
    made, below = [], None
    for level in range(deepest, -1, -1):
        own = leaves.where(F.col("level") == level)
        if below is not None:
            up = below.groupBy("g", F.expr(f"left(prefix, {level})").alias("up")).agg(F.sum("n").alias("n"), _joined(F.concat_ws(" ", "prefix", "digest")).alias("digest"))
            own = own.unionByName(up.select("g", F.col("up").alias("prefix"), F.lit(False).alias("leaf"), "n", "digest", F.lit(level).alias("level")))
        below = own
        made.append(own)
    return reduce(DataFrame.unionByName, made)


def save(lines: DataFrame, folder: str, leaf: int = LEAF) -> None:
    """Writes the lines(g, value) of a release and its trees."""
    spark = lines.sparkSession
    placed = _placed(lines, leaf)
    shard = F.substring("place", 1, 2)
    rows = placed.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", "g", "place")
    rows.select("g", "place", "value", "depth", "shard").write.partitionBy("shard").parquet(f"{folder}/lines")
    written = spark.read.schema(f"{LINES}, depth int").parquet(f"{folder}/lines")
    nodes(written).write.partitionBy("level").parquet(f"{folder}/nodes")


def roots(spark: SparkSession, folder: str) -> DataFrame:
    """(g, n, digest) of each graph. Graphs of equal size are equal if their digests are."""
    return spark.read.schema(NODES).parquet(f"{folder}/nodes").where("level = 0").select("g", "n", "digest")


def unequal_leaves(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(g, prefix) of the smallest parts of graphs that both trees have and that differ; a graph that one side lacks differs as a whole."""
    both = [spark.read.schema(NODES).parquet(f"{x}/nodes").withColumnsRenamed({c: f"{c}_{k}" for c in ("leaf", "n", "digest")}) for k, x in enumerate((old, new))]
    found, open_ = [], None
    for level in range(DEEPEST + 1):
        a, b = (x.where(F.col("level") == level).drop("level") for x in both)
        if open_ is not None:
            of = small(open_.select("g", F.col("prefix").alias("_up")))
            a, b = (x.withColumn("_up", F.expr(f"left(prefix, {level - 1})")).join(of, ["g", "_up"], "left_semi").drop("_up") for x in (a, b))
        apart = cut(a.join(b, ["g", "prefix"], "full_outer").where("not (digest_0 <=> digest_1)"))
        deeper = F.coalesce(~F.col("leaf_0") & ~F.col("leaf_1"), F.lit(False))
        found.append(apart.where(~deeper).select("g", "prefix"))
        open_ = apart.where(deeper)
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _within(lines: DataFrame, leaves: DataFrame, lengths: list[int], shards: list[str] | None) -> DataFrame:
    if shards is not None:
        lines = lines.where(F.col("shard").isin(*shards))
    parts = [lines.withColumn("prefix", F.expr(f"left(place, {n})")).join(leaves.where(F.length("prefix") == n), ["g", "prefix"], "left_semi") for n in lengths]
    return reduce(DataFrame.unionByName, parts, lines.withColumn("prefix", F.lit("")).limit(0)).select("g", "place", "value")


def changed_lines(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(g, value, change): lines that were added to or removed from graphs, of two releases that save wrote."""
    leaves = cut(unequal_leaves(spark, old, new))
    lengths = sorted(r[0] for r in leaves.select(F.length("prefix")).distinct().collect())
    shards = sorted(r[0] for r in leaves.select(F.substring("prefix", 1, 2)).distinct().collect()) if lengths and lengths[0] >= 2 else None
    a, b = (_within(spark.read.schema(LINES).parquet(f"{x}/lines"), small(leaves), lengths, shards) for x in (old, new))
    gone, came = (x.join(y.select("g", "place"), ["g", "place"], "left_anti").select("g", "value", F.lit(w).alias("change")) for x, y, w in ((a, b, "removed"), (b, a, "added")))
    return gone.unionByName(came)
