"""Small files that are there at once or not at all: a pointer that moves on, an exclusive file that only one writer can make.

A pointer is a folder of numbered files, of which the last one counts. Moving it writes a file apart and renames it to the next number, so a
reader finds the old one or the new one at any time, on stores too where putting one file in place of another leaves a gap.

They go through the Hadoop file system of their path, so they lie beside what Spark writes.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if it isn't there."""
    fs, at = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if it isn't there."""
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    fs, at = _path(spark, path)
    stream = fs.create(at, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file that isn't there; raises FileExistsError if it is. Of two writers at once one is refused."""
    try:
        _write(spark, path, text, False)
    except Exception as e:  # of the file system, whichever it is
        if exists(spark, path):
            raise FileExistsError(path) from e
        raise


def advance(spark: SparkSession, folder: str, value: dict, keep: int = 10) -> None:
    """Moves a pointer to value. Of two writers at once one is refused with FileExistsError; the last keep values stay."""
    fs, at = _path(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = _numbers(spark, folder)
    apart, number = path(f"{folder}/.{uuid4().hex}"), there[-1] + 1 if there else 0
    _write(spark, apart.toString(), json.dumps(value), False)
    if fs.exists(path(f"{folder}/{number:012d}")) or not fs.rename(apart, path(f"{folder}/{number:012d}")):
        fs.delete(apart, False)
        raise FileExistsError(f"{folder}/{number:012d}")
    for old in there[: -keep + 1 or None] if keep > 1 else there:
        fs.delete(path(f"{folder}/{old:012d}"), False)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n) for n in names(spark, folder) if n.isdigit())


def latest(spark: SparkSession, folder: str) -> dict | None:
    """The value that a pointer is at; None if it was never moved."""
    while there := _numbers(spark, folder):
        if (text := read(spark, f"{folder}/{there[-1]:012d}")) is not None:
            return json.loads(text)
    return None
