"""Paged sources over HTTP, as a Python data source: one partition per page, and a check that all pages came.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("url", ...).option("total", n).option("page", 1000).load()
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def get(url: str, tries: int = 3, longest_wait: float = 60, pause: Callable[[float], None] = time.sleep) -> bytes:
    """The bytes at url; server faults and 429 are tried again, after Retry-After up to longest_wait seconds."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if k == tries - 1 or e.code < 500 and e.code != 429:
                raise
            pause(min(float(e.headers.get("Retry-After") or 2**k), longest_wait))
    raise AssertionError


class _Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.total, self.page = options["url"], int(options["total"]), int(options.get("page", 1000))

    def partitions(self) -> list[InputPartition]:
        return [_Page(k) for k in range(0, self.total, self.page)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        page = json.loads(get(f"{self.url}?limit={self.page}&offset={partition.offset}"))
        rows = page["rows"]
        if len(rows) != page["count"] or page["total_count"] != self.total:
            raise ValueError(f"the page at {partition.offset} has {len(rows)} rows of {page['count']}, of {page['total_count']} in all")
        for k, row in enumerate(rows):
            yield partition.offset + k, json.dumps(row, sort_keys=True, ensure_ascii=False)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "row_idx bigint, row string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def complete(rows: DataFrame, total: int) -> DataFrame:
    """rows, if there are total of them; else it raises."""
    if (n := rows.count()) != total:
        raise ValueError(f"{n} rows of {total}")
    return rows


def to_fetch(inventory: DataFrame, cached: DataFrame) -> DataFrame:
    """Items of inventory(id, updated_at) that cached(id, updated_at, intact) doesn't hold in this state."""
    return inventory.join(cached.where("intact").select("id", "updated_at"), ["id", "updated_at"], "left_anti")


def unchanged(start: DataFrame, end: DataFrame) -> bool:
    """Whether the inventory was the same when the crawl ended as when it began."""
    return start.exceptAll(end).isEmpty() and end.exceptAll(start).isEmpty()


def is_zip(files: DataFrame) -> DataFrame:
    """files(path, content) with is_zip: a page of an application that stands in for an archive isn't one."""
    return files.withColumn("is_zip", F.substring("content", 1, 2) == F.lit(b"PK"))
