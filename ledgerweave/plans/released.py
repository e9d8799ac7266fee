"""A built release as the tables that the competency questions read, so that each question can be asked of it as it is.

Instances go by their addresses. A class's table is one filtered read of the quads and one aggregation by subject: predicates become columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import iri
from ..operators import quads as Q
from ..operators.lineage import cut


class Released:
    """quads and provenance as build writes them. Of a predicate with several values in a column the least counts; links have a table of their own."""

    def __init__(self, quads: DataFrame, provenance: DataFrame):
        self.quads, self.about = quads, provenance

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Released:
        return cls(spark.read.parquet(f"{folder}/quads"), spark.read.parquet(f"{folder}/provenance"))

    def _class(self, kinds: tuple[str, ...], quads: DataFrame | None = None, **columns: str) -> DataFrame:
        """(s, kind, g, label, *columns) of the instances of classes; columns are strings, named by the predicates they hold."""
        quads = self.quads if quads is None else quads
        types = quads.where((F.col("p") == Q.TYPE) & F.col("o").isin(*[iri.term("core", k) for k in kinds])).groupBy("s").agg(F.min(iri.local_name(F.col("o"))).alias("kind"), F.min("g").alias("g"))
        predicates = {"label": Q.LABEL} | {c: iri.term("core", p) for c, p in columns.items()}
        own = quads.where(F.col("p").isin(*predicates.values())).join(types.select("s"), "s", "left_semi")  # a class may be few of all that have labels
        values = own.groupBy("s").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in predicates.items()])
        return types.join(values, "s", "left")

    def _links(self, predicate: str, source: str, target: str) -> DataFrame:
        return self.quads.where(F.col("p") == iri.term("core", predicate)).select(F.col("s").alias(source), F.col("o").alias(target)).distinct()

    @cached_property
    def organ(self) -> DataFrame:
        """Ministries and abolished organs; one with several successors has a row for each."""
        rows = self._class(("Ministry", "AbolishedGovernmentOrgan")).select(F.col("s").alias("corp_no"), F.col("label").alias("name"), (F.col("kind") == "AbolishedGovernmentOrgan").alias("abolished"))
        return rows.join(self._links("succeededBy", "corp_no", "successor"), "corp_no", "left")

    @cached_property
    def organization(self) -> DataFrame:
        rows = self._class(("Organization",), prefecture="prefectureName", city="cityName")
        return rows.select(F.col("s").alias("corp_no"), F.col("label").alias("name"), "prefecture", "city")

    @cached_property
    def law(self) -> DataFrame:
        return self._class(("Law",), law_num="lawNum").select(F.col("s").alias("law_id"), F.col("label").alias("title"), "law_num")

    @cached_property
    def jurisdiction(self) -> DataFrame:
        return self._links("jurisdiction", "law_id", "organ")

    @cached_property
    def unresolved(self) -> DataFrame:
        rows = self._class(("UnresolvedReference",), reason="reason", law_id="unresolvedFor")
        return rows.join(self.law.select("law_id"), "law_id", "left_semi").select("law_id", "reason")

    @cached_property
    def revision(self) -> DataFrame:
        rows = self._class(("LawRevision",), law_id="revisionOf", d="enforcementDate", amendment="amendmentLawNum")
        return rows.select("law_id", F.col("d").cast("date").alias("d"), "g", "amendment")

    @cached_property
    def provenance(self) -> DataFrame:
        rows = self._class(("GraphProvenance",), self.about, source_name="sourceName", generated_on="generatedOn", recorded_on="recordedOn")
        return rows.select(F.col("s").alias("g"), F.col("generated_on").cast("date").alias("generated_on"), "source_name", F.col("recorded_on").cast("date").alias("recorded_on"))

    @cached_property
    def project(self) -> DataFrame:
        rows = self._class(("BudgetProject",), fiscal_year="fiscalYear", budget_amount="budgetAmount", ministry="ministry")
        return rows.select(F.col("s").alias("project_id"), F.col("label").alias("name"), _int("fiscal_year"), _long("budget_amount"), "ministry")

    @cached_property
    def project_law(self) -> DataFrame:
        return self._links("basisLaw", "project_id", "law_id")

    @cached_property
    def expenditure(self) -> DataFrame:
        rows = self._class(("Expenditure",), project_id="project", fiscal_year="fiscalYear", amount="amount", block_id="inBlock", category="recipientMatchCategory", recipient="recipient")
        return rows.select("project_id", _int("fiscal_year"), iri.local_name(F.col("s")).cast("int").alias("seq"), _long("amount"), "block_id", "category", "recipient")

    @cached_property
    def block(self) -> DataFrame:
        rows = self._class(("ExpenditureBlock",), project_id="project", fiscal_year="fiscalYear", amount="amount", paid="paidByGovernment")
        return rows.select("project_id", _int("fiscal_year"), F.col("s").alias("block_id"), F.col("label").alias("block_name"), _long("amount"), F.coalesce(F.col("paid") == "true", F.lit(False)).alias("paid"))

    @cached_property
    def funding(self) -> DataFrame:
        return self._links("fundedBy", "block_id", "source_id").join(self.block.select("project_id", "block_id"), "block_id").select("project_id", "block_id", "source_id")

    @cached_property
    def indirect(self) -> DataFrame:
        rows = self._class(("IndirectCost",), project_id="project", fiscal_year="fiscalYear", amount="amount")
        return rows.select("project_id", _int("fiscal_year"), F.col("label").alias("item"), _long("amount"))

    @cached_property
    def kept_block(self) -> DataFrame:
        return cut(self.block)

    @cached_property
    def kept_funding(self) -> DataFrame:
        return self.funding

    @cached_property
    def paid_items(self) -> DataFrame:
        """(fiscal_year, amount) of entry blocks and of indirect costs."""
        return self.block.where("paid").select("fiscal_year", "amount").unionByName(self.indirect.select("fiscal_year", "amount"))

    @cached_property
    def annual(self) -> DataFrame:
        measures = {"initial": "initialBudget", "supplementary": "supplementaryBudget", "carried_in": "carriedIn", "reserve": "reserve", "available": "available", "executed": "executed", "next_request": "nextYearRequest"}
        rows = self._class(("AnnualBudget",), project_id="project", sheet_year="fiscalYear", budget_year="budgetFiscalYear", **measures)
        return rows.select("project_id", _int("sheet_year"), _int("budget_year"), *[_long(m) for m in measures])


def _int(c: str) -> Column:
    return F.col(c).cast("int").alias(c)


def _long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)
