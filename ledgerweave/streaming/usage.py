"""Limits of use over a stream of requests: calls a minute for each client, tokens a day for all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calls_per_minute(requests: DataFrame, client: str = "client", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(minute, client, calls) in fixed windows of a minute. Works on a stream, where requests later than late are left out, and on a table."""
    rows = requests.withWatermark(ts, late) if requests.isStreaming else requests
    return rows.groupBy(F.window(ts, "1 minute").alias("w"), client).agg(F.count("*").alias("calls")).select(F.col("w.start").alias("minute"), client, "calls")


def over_limit(requests: DataFrame, limit: int, client: str = "client", ts: str = "ts") -> DataFrame:
    """Windows with more than limit calls, and how many calls were refused."""
    return calls_per_minute(requests, client, ts).where(F.col("calls") > limit).withColumn("refused", F.col("calls") - limit)


def tokens_per_day(requests: DataFrame, tokens: str, budget: int, ts: str = "ts") -> DataFrame:
    """(day, used, exhausted) by days in UTC."""
    return requests.groupBy(F.to_date(ts).alias("day")).agg(F.sum(tokens).alias("used")).withColumn("exhausted", F.col("used") >= budget)
