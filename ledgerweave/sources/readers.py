"""Readers of the source layouts. Every column is text and no schema is inferred; a header must be what is expected."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text as T
from .layouts import HEADERS

#: Places of the columns that are used, of headerless corporation rows with 30 columns.
CORPORATION = {"corp_no": 1, "updated_on": 4, "name": 6, "kind_code": 8, "prefecture": 9, "city": 10, "street": 11}
CORPORATION_WIDTH = 30
#: Places of the columns that are used, and widths, of budget-review files.
REVIEW = {
    "organization": (22, {"fiscal_year": 1, "project_id": 2, "name": 3, "kensei_jun": 4, "ministry": 5}),
    "summary": (32, {"fiscal_year": 1, "project_id": 2, "name": 3, "kensei_jun": 4, "ministry": 5}),
    "law": (28, {"fiscal_year": 1, "project_id": 2, "law_title": 19, "law_num": 20, "law_id": 21}),
    "budget": (44, {"fiscal_year": 1, "project_id": 2, "budget_fiscal_year": 13, "initial": 14, "supplementary": 15, "carried_in": 16, "reserve": 17, "available": 18, "executed": 19, "carried_out": 21, "next_year_request": 22}),
    "payee": (32, {"fiscal_year": 1, "project_id": 2, "block_id": 13, "block_name": 14, "payee_count": 15, "role": 16, "block_amount": 17, "payee": 18, "corp_no": 19, "other_flag": 22, "amount": 23, "contract_amount": 25}),
    "connection": (22, {"fiscal_year": 1, "project_id": 2, "block_from": 13, "block_from_name": 14, "paid": 15, "block_to": 16, "block_to_name": 17, "note": 18, "indirect_flag": 19, "item": 20, "amount": 21}),
}


class LayoutError(ValueError):
    """A file whose columns aren't the expected ones."""


def _rows_of(content: bytes, name: str) -> Iterator[list[str]]:
    """The rows of a CSV file, or of the one CSV file in a zip archive, read as a stream."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            inside = [x for x in archive.namelist() if x.lower().endswith(".csv")]
            if len(inside) != 1:
                raise LayoutError(f"{name}: {len(inside)} CSV files in the archive")
            with archive.open(inside[0]) as f:
                yield from csv.reader(io.TextIOWrapper(f, "utf-8-sig", newline=""))
    else:
        yield from csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", newline=""))


def csv_rows(spark: SparkSession, path: str, width: int, columns: dict[str, int], header: Sequence[str] | None = None) -> DataFrame:
    """Columns by place, with row_idx, of CSV files or zip archives of one. Rows of a file are numbered from 0, those of the next by name go on far above.

    Files are parts of the work: one file is read by one task as a stream of batches. A row of another width raises, and so
    does another header where one is given.
    """
    files = spark.read.format("binaryFile").load(path)
    place = {_plain(f): k << 40 for k, f in enumerate(sorted(files.inputFiles(), key=_plain))}
    schema = StructType([*[StructField(c, StringType()) for c in columns], StructField("row_idx", LongType())])
    kind = pa.schema([*[(c, pa.string()) for c in columns], ("row_idx", pa.int64())])
    places = list(columns.values())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = _rows_of(content.as_buffer().to_pybytes(), name)
                if header is not None and (first := next(rows, None)) != list(header):
                    raise LayoutError(f"{name}: unexpected header {first}")
                held: list[list] = []
                first_idx = place[_plain(name)]
                for k, row in enumerate(rows):
                    if len(row) != width:
                        raise LayoutError(f"{name}: row {k} has {len(row)} columns, not {width}")
                    held.append([*[row[p] for p in places], first_idx + k])
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), kind)], schema=kind)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), kind)], schema=kind)

    return files.select("path", "content").mapInArrow(read, schema)


def _plain(uri: str) -> str:
    """A file's path, however its address is written."""
    return unquote(uri.split(":", 1)[-1]).lstrip("/")


def corporations(spark: SparkSession, path: str, least_share: float = 0.5) -> DataFrame:
    """Corporation rows: those whose second column is a corporate number. If under least_share are, the layout is wrong: that raises."""
    rows = csv_rows(spark, path, CORPORATION_WIDTH, CORPORATION)
    fine = T.is_corporate_number(F.col("corp_no"))
    n, good = rows.agg(F.count("*"), F.count(F.when(fine, 1))).first()
    if n and good < least_share * n:
        raise LayoutError(f"{good} of {n} rows have a corporate number")
    return rows.where(fine)


def plain_corporations(spark: SparkSession, path: str) -> DataFrame:
    """As corporations, from uncompressed CSV without line breaks in cells: Spark's own reader, which splits files among tasks. row_idx only orders rows of a file."""
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(CORPORATION_WIDTH)])
    rows = spark.read.csv(path, schema=schema, mode="FAILFAST", header=False)
    return rows.select(*[F.coalesce(f"c{i}", F.lit("")).alias(n) for n, i in CORPORATION.items()], F.monotonically_increasing_id().alias("row_idx")).where(T.is_corporate_number(F.col("corp_no")))


def review(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A budget-review file by its kind in REVIEW. Its first row must be the known header: any drift of the layout raises."""
    width, columns = REVIEW[kind]
    return csv_rows(spark, path, width, columns, HEADERS[kind])


def commented(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A reference table with a header; lines that begin with # are left out."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, comment="#", enforceSchema=False, mode="FAILFAST")


_LAW = "law_info struct<law_id: string, law_num: string, law_num_type: string, law_type: string, promulgation_date: string>, current_revision_info struct<law_title: string, abbrev: string, repeal_status: string>, revision_info struct<amendment_law_num: string, amendment_enforcement_date: string, current_revision_status: string>"


def laws(spark: SparkSession, path: str) -> DataFrame:
    """Laws of JSON lines; abbrev may be absent, one text or a list."""
    raw = spark.read.schema(_LAW).json(path, mode="FAILFAST")
    abbrev = F.col("current_revision_info.abbrev")
    listed = F.when(abbrev.isNull(), F.array().cast("array<string>")).when(abbrev.startswith("["), F.from_json(abbrev, "array<string>")).otherwise(F.array(abbrev))
    date = lambda c: F.to_date(F.nullif(F.col(c), F.lit("")))
    return raw.select("law_info.law_id", "law_info.law_num", "law_info.law_num_type", "current_revision_info.law_title", listed.alias("abbrev"), date("law_info.promulgation_date").alias("promulgation_date"), "current_revision_info.repeal_status",
                      F.struct("revision_info.amendment_law_num", date("revision_info.amendment_enforcement_date").alias("enforcement_date"), F.col("revision_info.current_revision_status").alias("status")).alias("revision"))


def api_records(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects, annual budgets) of pages(rows array<struct<project_id, name, ministry, fiscal_year, budgets array<struct<year, initial, executed>>>>).

    Zero-padding of ids goes; a year that a project has twice raises; an executed amount belongs to the year before, whose row is made if it isn't there.
    """
    rows = pages.select(F.explode("rows").alias("r")).select(F.regexp_replace("r.project_id", "^0+(?=.)", "").alias("project_id"), "r.name", "r.ministry", F.col("r.fiscal_year").cast("int").alias("fiscal_year"), "r.budgets")
    years = rows.select("project_id", "fiscal_year", F.explode("budgets").alias("b")).select("project_id", "fiscal_year", F.col("b.year").cast("int").alias("budget_fiscal_year"), F.col("b.initial").cast("bigint").alias("initial"), F.col("b.executed").cast("bigint").alias("executed"))
    keys = ["project_id", "fiscal_year", "budget_fiscal_year"]
    once = years.groupBy(*keys).agg(F.count("*").alias("n"), F.first("initial").alias("initial"), F.first("executed").alias("executed"))
    once = once.where(F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("a year twice:"), *keys)).cast("boolean")))
    before = once.where("executed is not null").select("project_id", "fiscal_year", (F.col("budget_fiscal_year") - 1).alias("budget_fiscal_year"), "executed")
    return rows.drop("budgets"), once.select(*keys, "initial").join(before, keys, "full_outer")


def check_pages(pages: DataFrame) -> None:
    """pages(sha256, content, declared_rows, rows, year): bytes, numbers, years and ids must be what they say; anything else raises."""
    row = pages.agg(F.count(F.when(F.sha2("content", 256) != F.col("sha256"), 1)).alias("bytes"), F.count(F.when(F.size("rows") != F.col("declared_rows"), 1)).alias("rows"), F.count_distinct("year").alias("years")).first()
    ids = pages.select(F.explode("rows.project_id").alias("id")).groupBy("id").count().where("count > 1").count()
    if row["bytes"] or row["rows"] or row["years"] > 1 or ids:
        raise LayoutError(f"pages with other bytes {row['bytes']}, with other numbers of rows {row['rows']}, years {row['years']}, repeated ids {ids}")
