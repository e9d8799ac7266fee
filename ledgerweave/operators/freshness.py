"""How old sources are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stale(sources: DataFrame, fetched: DataFrame, today: Column) -> DataFrame:
    """(source, last_fetched_on, cadence, days) of sources(source, cadence) last in fetched(source, date) more than cadence days ago, or never.

    Sources without a cadence never go stale. No source at all raises: that nothing is stale would say nothing.
    """
    if sources.isEmpty():
        raise ValueError("no source is registered")
    last = fetched.groupBy("source").agg(F.max("date").alias("last_fetched_on"))
    rows = sources.where("cadence is not null").join(last, "source", "left").withColumn("days", F.datediff(today, "last_fetched_on"))
    return rows.where(F.col("last_fetched_on").isNull() | (F.col("days") > F.col("cadence"))).select("source", "last_fetched_on", "cadence", "days")


def folded(rows: DataFrame) -> DataFrame:
    """rows(source_name, as_of, date_kind) with equal ones counted as graphs."""
    return rows.groupBy("source_name", F.to_date("as_of").alias("as_of"), "date_kind").agg(F.count("*").alias("graphs"))
