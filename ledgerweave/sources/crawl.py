"""A crawl of a paged list as a stream: offsets are pages, each batch fetches some of them with a partition for each, and a run keeps what came.

The list may change while it is crawled. An inventory of it is taken before and after; the crawl is complete only if they agree and every item of it was seen.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .rest import get, unchanged
from .runs import Run

INVENTORY = "id string, updated_at string"


def _file(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Pages(DataSourceStreamReader):
    """Offsets are {"page": k}. How far batches were planned is kept in a file of its own, as a stream that starts again asks for
    its next offset before it tells where it was."""

    def __init__(self, options: dict):
        self.url, self.size, self.per_batch = options["url"], int(options.get("page", 100)), int(options.get("pages_per_batch", 10))
        self.progress, self.pages = options["progress"], -(-int(options["total"]) // self.size)

    def _planned(self) -> int:
        store, at = _file(self.progress)
        if store.get_file_info(at).type == fs.FileType.NotFound:
            return 0
        with store.open_input_stream(at) as f:
            return int(f.read() or 0)

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": min(self.pages, self._planned() + self.per_batch)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["page"] > self._planned():
            store, at = _file(self.progress)
            store.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(f"{at}.new") as f:
                f.write(str(end["page"]).encode())
            store.move(f"{at}.new", at)
        return [_Page(k) for k in range(start["page"], end["page"])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        url = f"{self.url}?limit={self.size}&offset={partition.number * self.size}"
        content = get(url)
        page = json.loads(content)
        if len(page["rows"]) != page["count"]:
            raise ValueError(f"page {partition.number} has {len(page['rows'])} rows of {page['count']}")
        yield f"page-{partition.number}", url, content


class CrawlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return "key string, url string, content binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Pages(self.options)


def inventory(spark: SparkSession, url: str) -> DataFrame:
    """(id, updated_at) as the list's address for it says now; one answer has all, as it is what a crawl is held against."""
    rows = json.loads(get(f"{url}/inventory"))["rows"]
    return spark.createDataFrame([(str(r["id"]), r["updated_at"]) for r in rows], INVENTORY)


def items(contents: DataFrame) -> DataFrame:
    """(id, updated_at, row) of the rows of pages(content)."""
    rows = F.from_json(F.get_json_object(F.decode("content", "utf-8"), "$.rows"), "array<string>")
    one = contents.select(F.explode(rows).alias("row"))
    return one.select(F.get_json_object("row", "$.id").alias("id"), F.get_json_object("row", "$.updated_at").alias("updated_at"), "row")


def crawl(run: Run, url: str, page: int = 100, pages_per_batch: int = 10) -> bool:
    """Fetches all pages into the run, from where it was stopped; says whether it is complete. What was fetched isn't fetched again."""
    spark = run.spark
    spark.dataSource.register(CrawlSource)
    folder = f"{run.folder}/crawl"
    if "total" not in run.state:
        inventory(spark, url).write.mode("overwrite").parquet(f"{folder}/inventory")
        run._move(total=spark.read.parquet(f"{folder}/inventory").count())
    first = spark.read.schema(INVENTORY).parquet(f"{folder}/inventory")
    pages = spark.readStream.format("crawl").option("url", url).option("total", run.state["total"]).option("page", page).option("pages_per_batch", pages_per_batch).option("progress", f"{folder}/planned").load()
    query = pages.writeStream.foreachBatch(lambda batch, number: run.store(batch, number)).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    seen = items(run.cached())
    whole = unchanged(first, inventory(spark, url)) and first.join(seen, ["id", "updated_at"], "left_anti").isEmpty()
    run.finish(whole, items=seen.select("id").distinct().count())
    return whole
