"""Checks before a release: shapes per graph, references across graphs, arithmetic, and the gate.

Every check that can pass without looking returns how many rows it looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import iri
from ..schema import MATCH_CATEGORIES, REFERENCES, SUPERCLASSES, UNRESOLVED_REASONS
from .quads import LITERAL, TYPE


@dataclass(frozen=True)
class Property:
    """What a shape says of one predicate (by local name)."""

    least: int = 0
    most: int | None = 1
    kind: str | None = None
    datatype: str | None = None
    pattern: str | None = None
    values: tuple[str, ...] = ()


#: Shapes by class: closed, so any other predicate is a violation.
SHAPES: dict[str, dict[str, Property]] = {
    "Law": {"lawNum": Property(1), "promulgationDate": Property(), "jurisdiction": Property(most=None, kind="uri")},
    "BudgetProject": {"fiscalYear": Property(1), "projectId": Property(1), "budgetAmount": Property(), "ministry": Property(kind="uri"), "basisLaw": Property(most=None, kind="uri")},
    "Organization": {"corporateNumber": Property(1, pattern="^[0-9]{13}$"), "prefectureName": Property(), "cityName": Property()},
    "Expenditure": {"fiscalYear": Property(1), "project": Property(1, kind="uri"), "amount": Property(1), "recipientMatchCategory": Property(1, values=MATCH_CATEGORIES), "recipient": Property(kind="uri"), "payeeLabel": Property(), "inBlock": Property(kind="uri")},
    "ExpenditureBlock": {"fiscalYear": Property(1), "project": Property(1, kind="uri"), "blockId": Property(1), "amount": Property(), "paidByGovernment": Property(1), "fundedBy": Property(most=None, kind="uri"), "flowNote": Property(most=None)},
    "AnnualBudget": {"fiscalYear": Property(1), "budgetFiscalYear": Property(1), "project": Property(1, kind="uri")} | {p: Property() for p in ("initialBudget", "supplementaryBudget", "carriedIn", "reserve", "available", "executed", "carriedOut", "nextYearRequest")},
    "IndirectCost": {"fiscalYear": Property(1), "project": Property(1, kind="uri"), "amount": Property(1)},
    "LawRevision": {"revisionOf": Property(1, kind="uri"), "enforcementDate": Property(1, pattern=r"^\d{4}-\d{2}-\d{2}$"), "amendmentLawNum": Property(), "revisionStatus": Property()},
    "Ministry": {"corporateNumber": Property(1, pattern="^[0-9]{13}$"), "ministryCode": Property()},
    "AbolishedGovernmentOrgan": {"abolitionDate": Property(1, pattern=r"^\d{4}-\d{2}-\d{2}$"), "succeededBy": Property(1, None, kind="uri")},
    "UnresolvedReference": {"text": Property(1), "reason": Property(1, values=UNRESOLVED_REASONS), "unresolvedFor": Property(kind="uri")},
}


def _rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def violations(quads: DataFrame, shapes: dict[str, dict[str, Property]] = SHAPES) -> DataFrame:
    """(g, s, class, predicate, rule) of what breaks a shape; graphs are judged each by itself.

    All rules are read from one table of properties and one count per subject and predicate: two joins for any number of shapes.
    """
    spark = quads.sparkSession
    rules = F.broadcast(_rows(spark, [(c, p, x.least, x.most, x.kind, x.datatype, x.pattern, list(x.values) or None) for c, ps in shapes.items() for p, x in ps.items()], "class string, predicate string, least int, most int, kind string, datatype string, pattern string, allowed array<string>"))
    typed = quads.where(F.col("p") == TYPE).select("g", "s", iri.local_name(F.col("o")).alias("class")).where(F.col("class").isin(*shapes)).distinct()
    own = quads.where(~F.col("p").isin(TYPE) & ~F.col("p").endswith("#prefLabel")).select("g", "s", iri.local_name(F.col("p")).alias("predicate"), "o", "o_kind", "o_dt")
    facts = typed.join(own, ["g", "s"]).join(rules, ["class", "predicate"], "left")
    bad = F.array_compact(F.array(
        F.when(F.col("least").isNull(), "closed"), F.when(F.col("kind").isNotNull() & (F.col("kind") != F.col("o_kind")), "kind"), F.when(F.col("datatype").isNotNull() & ~F.col("datatype").eqNullSafe(F.col("o_dt")), "datatype"),
        F.when(F.col("pattern").isNotNull() & ~F.rlike("o", F.col("pattern")), "pattern"), F.when(F.col("allowed").isNotNull() & ~F.expr("array_contains(allowed, o)"), "in"),
    ))
    by_value = facts.select("g", "s", "class", "predicate", F.explode(bad).alias("rule"))
    counts = own.groupBy("g", "s", "predicate").agg(F.count("*").alias("n"))
    wanted = typed.join(rules.select("class", "predicate", "least", "most"), "class").join(counts, ["g", "s", "predicate"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_count = wanted.select("g", "s", "class", "predicate", F.when(F.col("n") < F.col("least"), "least").when(F.col("n") > F.col("most"), "most").alias("rule")).where("rule is not null")
    return by_value.unionByName(by_count)


def uncovered_classes(quads: DataFrame, shapes: dict[str, dict[str, Property]] = SHAPES) -> DataFrame:
    """Classes that are used but have no shape; none used at all raises, as nothing would be checked."""
    used = quads.where(F.col("p") == TYPE).select(iri.local_name(F.col("o")).alias("class")).distinct()
    if used.isEmpty():
        raise ValueError("no instance of any class")
    return used.where(~F.col("class").isin(*shapes))


def passing(quads: DataFrame, found: DataFrame) -> DataFrame:
    """Quads of graphs without a violation."""
    return quads.join(found.select("g").distinct(), "g", "left_anti")


def quarantined(quads: DataFrame, found: DataFrame, folder: str) -> None:
    """Quads of failing graphs, and the violations, each in a file of its own by graph."""
    quads.join(found.select("g").distinct(), "g", "left_semi").write.mode("errorifexists").partitionBy("g").parquet(f"{folder}/quads")
    found.write.mode("errorifexists").parquet(f"{folder}/violations")


def class_closure(spark: SparkSession, superclasses: tuple[tuple[str, str], ...] = SUPERCLASSES) -> DataFrame:
    """(sub, super), each class under itself and all above it. The ontology is fixed and small."""
    above = {}
    for sub, sup in superclasses:
        above.setdefault(sub, []).append(sup)
    pairs = []
    for c in {x for p in superclasses for x in p}:
        todo = [c]
        while todo:
            pairs.append((c, at := todo.pop()))
            todo += above.get(at, [])
    return _rows(spark, sorted({*pairs}), "sub string, super string")


def broken_references(quads: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """(s, predicate, o, expected, reason): links whose object isn't an instance of the class that the predicate asks for.

    reason: untyped (no type in any graph) or wrong_type. Objects in external(id, class) count as instances, so large graphs need not be joined in.
    """
    spark = quads.sparkSession
    expected = F.broadcast(_rows(spark, list(REFERENCES), "predicate string, expected string"))
    typed = quads.where(F.col("p") == TYPE).select(F.col("s").alias("o"), iri.local_name(F.col("o")).alias("sub"))
    if external is not None:
        typed = typed.unionByName(external.select(F.col("id").alias("o"), F.col("class").alias("sub")))
    closure = F.broadcast(class_closure(spark))
    types = typed.distinct().join(closure, "sub", "left").select("o", F.coalesce("super", "sub").alias("expected")).distinct()
    links = quads.where(F.col("o_kind") != LITERAL).select("s", iri.local_name(F.col("p")).alias("predicate"), "o").distinct().join(expected, "predicate")
    missing = links.join(types, ["o", "expected"], "left_anti")
    any_type = typed.select("o").distinct().withColumn("_typed", F.lit(True))
    return missing.join(any_type, "o", "left").select("s", "predicate", "o", "expected", F.when(F.col("_typed"), "wrong_type").otherwise("untyped").alias("reason"))


def block_sums(blocks: DataFrame, expenditures: DataFrame) -> DataFrame:
    """(fiscal_year, project_id, block_id, amount, total, wrong): blocks with an amount against the sum of their expenditures; blocks without either aren't compared."""
    keys = ["fiscal_year", "project_id", "block_id"]
    total = expenditures.where("amount is not null").groupBy(*keys).agg(F.sum("amount").alias("total"))
    return blocks.where("amount is not null").select(*keys, "amount").join(total, keys).withColumn("wrong", F.col("amount") != F.col("total"))


def annual_identities(annual: DataFrame) -> DataFrame:
    """annual with wrong: initial, supplementary, carried in and reserve should make up what is available; rows with a null among them aren't compared."""
    parts = ("initial", "supplementary", "carried_in", "reserve")
    return annual.dropna(subset=[*parts, "available"]).withColumn("wrong", sum((F.col(p) for p in parts[1:]), F.col(parts[0])) != F.col("available"))


def project_amounts(projects: DataFrame, annual: DataFrame) -> DataFrame:
    """(fiscal_year, project_id, budget_amount, initials, wrong): a project's amount against the initial budgets of its own year; projects without one aren't compared."""
    own = annual.where("initial is not null").groupBy(F.col("budget_fiscal_year").alias("fiscal_year"), "project_id").agg(F.sort_array(F.collect_set("initial")).alias("initials"))
    rows = projects.where("budget_amount is not null").select("fiscal_year", "project_id", "budget_amount").join(own, ["fiscal_year", "project_id"])
    return rows.withColumn("wrong", F.col("initials") != F.array("budget_amount"))


def breakdown_totals(detail: DataFrame, aggregate: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, parts, wrong): the total of an aggregate row against the sum of its breakdown by kind; rows without a breakdown aren't compared."""
    parts = detail.where("amount is not null").groupBy(*keys).agg(F.sum("amount").alias("parts"))
    return aggregate.where("amount is not null").select(*keys, F.col("amount").alias("total")).join(parts, keys).withColumn("wrong", F.col("total") != F.col("parts"))


def count_mismatches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose count n differs between two tables; a missing key counts 0."""
    joined = left.withColumnRenamed("n", "n_left").join(right.withColumnRenamed("n", "n_right"), keys, "full_outer")
    joined = joined.withColumns({"n_left": F.coalesce("n_left", F.lit(0).cast("bigint")), "n_right": F.coalesce("n_right", F.lit(0).cast("bigint"))})
    return joined.where("n_left <> n_right")


def stray_addresses(texts: DataFrame, hosts: list[str], base: str = iri.BASE) -> DataFrame:
    """(source, iri) of addresses in texts(source, text) that are neither under the base nor at an allowed host."""
    found = texts.select("source", F.explode(F.regexp_extract_all("text", F.lit(r"(https?://[^\s<>\"']+)"), 1)).alias("iri")).distinct()
    host = F.regexp_extract("iri", r"^https?://([^/]+)", 1)
    return found.where(~F.col("iri").startswith(base) & ~host.isin(*hosts))


def rebased(quads: DataFrame, old: str, new: str) -> DataFrame:
    """quads with all addresses under old moved to new."""
    move = lambda c: F.when(F.col(c).startswith(old), F.concat(F.lit(new), F.expr(f"substring({c}, {len(old) + 1})"))).otherwise(F.col(c))
    return quads.withColumns({"s": move("s"), "p": move("p"), "g": move("g"), "o": F.when(F.col("o_kind") == "uri", move("o")).otherwise(F.col("o"))})


class ReleaseRefused(Exception):
    """What the gate found; the report is written before it is raised."""


@dataclass
class Gate:
    """Counts of faults by name; checked has how many rows each check looked at."""

    faults: dict[str, int] = field(default_factory=dict)
    checked: dict[str, int] = field(default_factory=dict)

    def add(self, name: str, rows: DataFrame, wrong: Column | None = None) -> None:
        n, bad = rows.agg(F.count("*"), F.count("*") if wrong is None else F.count(F.when(wrong, 1))).first()
        self.checked[name], self.faults[name] = n, bad

    def close(self, allow_partial: bool = False, must_check: tuple[str, ...] = ()) -> list[str]:
        """The messages; raises if there is a fault, unless a partial release is allowed. A check in must_check that saw no rows is a fault."""
        said = [f"{n}: {k}" for n, k in self.faults.items() if k] + [f"{n}: nothing was checked" for n in must_check if not self.checked.get(n)]
        if said and not allow_partial:
            raise ReleaseRefused("; ".join(said))
        return said
