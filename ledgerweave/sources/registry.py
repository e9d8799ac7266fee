"""The sources that are known, how often each should be fetched, and what files a snapshot of the budget review has."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lake
from .layouts import FILES as GROUPS


@dataclass(frozen=True)
class Source:
    """access is bulk, api or file; a cadence of None never goes stale."""

    id: str
    name: str
    access: str
    cadence: int | None = None
    licence: str = "Public Data License 1.0"
    groups: tuple[str, ...] = ()


REQUIRED, OPTIONAL = ("summary", "budget", "law", "payee"), ("connection",)

SOURCES = {
    s.id: s
    for s in (
        Source("houjin-bangou", "corporate register, all corporations", "bulk", 31), Source("egov-law", "metadata of all laws", "api", 31), Source("egov-law-data", "text of one law", "api"), Source("ministry-codes", "reference table of ministries", "file"),
        Source("rs-system", "budget review, files by group", "bulk", 366, groups=tuple(GROUPS)), Source("rs-system-api", "budget review, list of projects", "api"), Source("rs-system-api-details", "budget review, details of projects", "api"),
    )
}


def frame(spark: SparkSession, sources: Mapping[str, Source] = SOURCES) -> DataFrame:
    """(source, name, access, cadence, licence)"""
    return spark.createDataFrame([(s.id, s.name, s.access, s.cadence, s.licence) for s in sources.values()], "source string, name string, access string, cadence int, licence string")


def check(sources: Mapping[str, Source] = SOURCES) -> None:
    """Raises if a source has another id than its key, an unknown access, or a cadence that isn't positive."""
    for key, s in sources.items():
        if key != s.id or s.access not in ("bulk", "api", "file") or s.cadence is not None and s.cadence <= 0:
            raise ValueError(f"a wrong entry: {key}")


def group_of(file: Column) -> Column:
    """The group of a file name by its template, whatever the year; null for others."""
    out = None
    for group, template in GROUPS.items():
        head, _, tail = template.partition("{year}")
        hit = file.rlike(rf"^\Q{head}\E[0-9]+\Q{tail}\E(?:\.(?:zip|csv))?$")
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out


def group_files(snapshots: DataFrame, date: str) -> dict[str, str]:
    """The files of a day's budget-review snapshot by group. A missing required group raises, an optional one is left out."""
    rows = snapshots.where((F.col("source") == "rs-system") & (F.col("date") == F.lit(date).cast("date"))).select(group_of(F.col("file")).alias("g"), "file").where("g is not null")
    found = {r["g"]: r["file"] for r in rows.groupBy("g").agg(F.min("file").alias("file")).collect()}
    if missing := [g for g in REQUIRED if g not in found]:
        raise FileNotFoundError(f"no file of {missing} on {date}")
    return found


def fetch_all(spark: SparkSession, root: str, date: str, wanted: Mapping[str, Mapping[str, Callable[[], bytes]]]) -> dict[str, str]:
    """Fetches wanted[source][file] into the lake; says for each source fetched, skipped or failed: why. One source's failure doesn't stop others."""
    out = {}
    for source, files in wanted.items():
        if source not in SOURCES:
            raise ValueError(f"an unknown source: {source}")
        try:
            done = [lake.fetch(spark, root, source, date, file, fetcher) for file, fetcher in files.items()]
            out[source] = "fetched" if any(done) else "skipped"
        except Exception as e:  # the next source may still be there
            out[source] = f"failed: {e}"
    return out
