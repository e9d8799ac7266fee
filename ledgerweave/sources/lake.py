"""Immutable dated snapshots: a folder for each source, date and file, and a manifest row as its commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "source string, date date, file string, sha256 string, size bigint"


def manifest(spark: SparkSession, lake: str) -> DataFrame:
    """The committed snapshots; an empty table where the lake is new."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{lake}/_manifest")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(MANIFEST).parquet(f"{lake}/_manifest") if there else spark.createDataFrame([], MANIFEST)


def save(spark: SparkSession, lake: str, source: str, date: str, file: str, content: bytes) -> None:
    """Writes a snapshot, then its manifest row. One that is committed isn't written again: that raises."""
    if not missing(spark, lake, [(source, date, file)]):
        raise FileExistsError(f"{source} {date} {file}")
    row = spark.createDataFrame([(source, date, file, bytearray(content))], "source string, date string, file string, content binary")
    row.select("content").write.mode("overwrite").parquet(_folder(lake, source, date, file))
    row.select("source", F.to_date("date").alias("date"), "file", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("size")).write.mode("append").parquet(f"{lake}/_manifest")


def _folder(lake: str, source: str, date: str, file: str) -> str:
    return f"{lake}/source={source}/date={date}/file={file}"


def load(spark: SparkSession, lake: str, source: str, date: str, file: str) -> bytes:
    """A committed snapshot's bytes, checked against the manifest."""
    wanted = manifest(spark, lake).where((F.col("source") == source) & (F.col("date") == F.lit(date).cast("date")) & (F.col("file") == file)).first()
    if wanted is None:
        raise FileNotFoundError(f"{source} {date} {file}")
    row = spark.read.parquet(_folder(lake, source, date, file)).select("content", F.sha2("content", 256).alias("d")).first()
    if row["d"] != wanted["sha256"]:
        raise ValueError(f"{source} {date} {file} isn't what was committed")
    return bytes(row["content"])


def missing(spark: SparkSession, lake: str, wanted: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Of wanted (source, date, file) those that aren't committed."""
    asked = spark.createDataFrame(wanted, "source string, date string, file string").withColumn("date", F.to_date("date"))
    rest = asked.join(manifest(spark, lake), ["source", "date", "file"], "left_anti")
    return [(r["source"], str(r["date"]), r["file"]) for r in rest.collect()]


def fetch(spark: SparkSession, lake: str, source: str, date: str, file: str, fetcher: Callable[[], bytes]) -> bool:
    """Fetches a snapshot unless it is committed; says whether it did."""
    if not missing(spark, lake, [(source, date, file)]):
        return False
    save(spark, lake, source, date, file, fetcher())
    return True


def latest(snapshots: DataFrame) -> DataFrame:
    """(source, date, file): the last date of each source, of its files the last by name."""
    return snapshots.groupBy("source").agg(F.max(F.struct("date", "file")).alias("m")).select("source", "m.date", "m.file")


def latest_before(snapshots: DataFrame, date: Column) -> DataFrame:
    """As latest, of snapshots up to and on date."""
    return latest(snapshots.where(F.col("date") <= date))
