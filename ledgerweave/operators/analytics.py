"""Ratios, shares and rankings for display, with guarded denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent; null without a positive whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * 100)


def shares(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """rows with share: value in percent of the sum over by. The sums are joined, not windowed over all rows in one task."""
    if not by:
        total = rows.agg(F.sum(value).alias("_t")).withColumn("_all", F.lit(1))
        return rows.withColumn("_all", F.lit(1)).join(F.broadcast(total), "_all").withColumn("share", percent(F.col(value), F.col("_t"))).drop("_t", "_all")
    total = rows.groupBy(*by).agg(F.sum(value).alias("_t"))
    return rows.join(total, by).withColumn("share", percent(F.col(value), F.col("_t"))).drop("_t")


def ranked(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    return rows.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(value))))


def value_range(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.min(value).alias("least"), F.max(value).alias("most"))


def first_groups(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """Rows of the n groups that appear first in order. The places of groups are ranked, not the rows."""
    places = rows.groupBy(group).agg(F.min(F.struct(*order)).alias("_at")).orderBy("_at").limit(n).select(group)
    return rows.join(F.broadcast(places), group, "left_semi")


def ratio_buckets(pairs: DataFrame) -> DataFrame:
    """(bucket, n) for pairs(paid, executed): how many times the executed amount was paid out: 1, 2, 3, zero, other, or no-denominator."""
    paid, executed = F.col("paid"), F.col("executed")
    bucket = F.when(executed.isNull() | (executed == 0), "no-denominator").when(paid == 0, "zero")
    for k in (1, 2, 3):
        bucket = bucket.when(paid == executed * k, str(k))
    return pairs.groupBy(bucket.otherwise("other").alias("bucket")).agg(F.count("*").alias("n"))


def zero_filled(counts: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """counts(key, n) for all values, with 0 for those without a row."""
    every = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(key))
    return every.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def budget_rollup(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Totals for each prefix of keys and overall; an extension."""
    return rows.rollup(*keys).agg(F.sum(value).alias("total"), F.grouping_id().alias("level"))
