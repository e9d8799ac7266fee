"""A snapshot of the list of projects as an API gives it: pages of JSON and a manifest of them, checked as a whole, then projects and annual budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import LayoutError

_ROWS = "array<struct<id: string, project_number: string, name: string, fiscal_year: int, is_published: boolean, finalized_amount_for_initial_budget: bigint, previous_year_execution_amount: bigint, budget_data: array<struct<fiscal_year: int, initial_budgets_total_amount: bigint>>>>"
MANIFEST = "file string, sha256 string, rows bigint"


def checked(pages: DataFrame, manifest: DataFrame, reported: int, year: int) -> DataFrame:
    """The rows of pages(file, content) that manifest(file, sha256, rows) names, if all is what it says; else LayoutError says what isn't.

    Bytes and numbers of rows of each page, the number of all rows that the API reported, one year, only published rows, no id twice.
    """
    parsed = F.from_json(F.decode("content", "utf-8"), f"results {_ROWS}")
    held = manifest.join(pages, "file", "left").select("file", "sha256", "rows", "content", F.coalesce(parsed["results"], F.array().cast(_ROWS)).alias("results"))
    of_page = held.agg(F.count("*").alias("pages"), F.count(F.when(~F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False)), 1)).alias("bytes"), F.count(F.when(F.size("results") != F.col("rows"), 1)).alias("numbers"), F.coalesce(F.sum(F.size("results")), F.lit(0)).alias("rows")).first()
    rows = held.select(F.explode("results").alias("r")).select("r.*")
    of_row = rows.agg(F.count(F.when(~F.coalesce(F.col("fiscal_year") == year, F.lit(False)), 1)).alias("years"), F.count(F.when(~F.coalesce("is_published", F.lit(False)), 1)).alias("unpublished")).first()
    twice = rows.groupBy("id").count().where("count > 1").count()
    wrong = {"no page": not of_page["pages"], "pages with other bytes": of_page["bytes"], "pages with other numbers of rows": of_page["numbers"], f"rows in all, {reported} reported": of_page["rows"] if of_page["rows"] != reported else 0, "rows of other years": of_row["years"], "unpublished rows": of_row["unpublished"], "ids twice": twice}
    if said := [f"{n} {what}" if n is not True else what for what, n in wrong.items() if n]:
        raise LayoutError("; ".join(said))
    return rows


def _or_raise(fine: Column, *said: Column | str) -> Column:
    parts = [F.lit(x) if isinstance(x, str) else x.cast("string") for x in said]
    return F.when(fine, True).otherwise(F.raise_error(F.concat_ws(" ", *parts)).cast("boolean"))


def records(rows: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """(projects, annual budgets) of checked rows.

    A project's number is digits, without zeros before it, and no two are equal then. A project's own year has the initial amount of its history, or of the list where the history
    has none; where both have one they must agree. What was executed belongs to the year before, which gets a row if the history has none. A year that a history has twice raises.
    """
    number = F.regexp_replace("project_number", "^0+(?=[0-9])", "")
    rows = rows.where(_or_raise(F.coalesce(F.col("project_number").rlike("^[0-9]+$"), F.lit(False)), "not a number:", F.coalesce("project_number", F.lit("null")))).withColumn("project_id", number)
    one = rows.groupBy("project_id").agg(F.count("*").alias("n")).where(_or_raise(F.col("n") == 1, "a number twice:", F.col("project_id"))).select("project_id")
    rows = rows.join(one, "project_id")
    budgets = F.coalesce("budget_data", F.array().cast("array<struct<fiscal_year: int, initial_budgets_total_amount: bigint>>"))
    years = F.transform(budgets, lambda b: b["fiscal_year"])
    rows = rows.where(_or_raise(F.size(F.array_distinct(years)) == F.size(years), "a year twice:", F.col("project_id")))
    own = F.get(F.filter(budgets, lambda b: b["fiscal_year"] == year), F.lit(0))["initial_budgets_total_amount"]
    listed, executed = F.col("finalized_amount_for_initial_budget"), F.col("previous_year_execution_amount")
    rows = rows.where(_or_raise(own.isNull() | listed.isNull() | (own == listed), "list and history differ:", F.col("project_id")))
    projects = rows.select("project_id", F.lit(year).alias("fiscal_year"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce(own, listed).alias("budget_amount"))
    of = lambda at, initial: F.struct(at.cast("int").alias("budget_fiscal_year"), initial.cast("bigint").alias("initial"), F.when(at == year - 1, executed).alias("executed"))
    history = F.transform(budgets, lambda b: of(b["fiscal_year"], b["initial_budgets_total_amount"]))
    before = F.when(executed.isNotNull() & ~F.array_contains(years, year - 1), F.array(of(F.lit(year - 1), F.lit(None))))
    annual = rows.select("project_id", F.lit(year).alias("fiscal_year"), F.explode(F.concat(history, F.coalesce(before, F.slice(history, 1, 0)))).alias("b")).select("project_id", "fiscal_year", "b.*")
    return projects, annual
