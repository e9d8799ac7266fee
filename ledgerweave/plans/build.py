"""The build: source files to typed tables, quads, checks, and a release that passes the gate.

Tables are DataFrames throughout. The actions are the writes of the tables, whose jobs count what the report tells of them, the writes of the quads
before and after the checks, one count for each check and the report, which is written before the gate decides.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import iri
from ..functions import text as T
from ..operators import quads as Q
from ..operators import pointer, records, release, resolve, validate
from ..schema import MATCH_CATEGORIES, SENTINELS, TABLES, UNRESOLVED_REASONS
from ..sources import readers, succession
from ..sources.registry import SOURCES

#: Sources that have a graph in a release, and the graph that says where these come from.
GRAPHS = ("houjin-bangou", "egov-law", "egov-law-data", "rs-system", "ministry-codes")
#: What each graph is made from, itself first: a change in any of them makes it anew.
NEEDS = {
    "houjin-bangou": ("houjin-bangou", "rs-system", "ministry-codes"), "ministry-codes": ("ministry-codes", "houjin-bangou"), "egov-law-data": ("egov-law-data", "ministry-codes", "houjin-bangou"),
    "egov-law": ("egov-law", "egov-law-data", "ministry-codes", "houjin-bangou"), "rs-system": ("rs-system", "egov-law", "egov-law-data", "ministry-codes", "houjin-bangou"),
}
PROVENANCE = f"{iri.BASE}/graph/provenance"
#: Columns of annual budgets and their predicates.
MEASURES = {
    "initial": "initialBudget", "supplementary": "supplementaryBudget", "carried_in": "carriedIn", "reserve": "reserve", "available": "available",
    "executed": "executed", "carried_out": "carriedOut", "next_year_request": "nextYearRequest",
}


@dataclass(frozen=True)
class Inputs:
    """Paths of one snapshot. laws may be missing, and with it jurisdictions; connections too, and with it flows of money.

    succession is the document of the law whose table says what became of the old ministries; laws then have abolished organs too.
    recorded has the day of recording of sources for which it is known. plain_register says that the register is uncompressed and without line breaks in
    cells, so that its files are split among tasks.
    """

    corporations: str
    ministries: str
    summary: str
    budget: str
    law_citations: str
    payees: str
    connections: str | None = None
    laws: str | None = None
    old_ministries: str | None = None
    succession: str | None = None
    date: str = "2024-01-01"
    payees_only: bool = True
    plain_register: bool = False
    recorded: dict[str, str] = field(default_factory=dict)


@dataclass
class Built:
    tables: dict[str, DataFrame]
    quads: DataFrame
    violations: DataFrame
    gate: validate.Gate
    messages: list[str] = field(default_factory=list)
    provenance: DataFrame | None = None


class _Kept(dict):
    """Tables by name, each put through keep when it is set, so that what is made from it reads what was kept."""

    def __init__(self, keep: Callable[[str, DataFrame], DataFrame]):
        super().__init__()
        self.keep = keep

    def __setitem__(self, name: str, rows: DataFrame) -> None:
        super().__setitem__(name, self.keep(name, rows))


def tables(spark: SparkSession, inputs: Inputs, keep: Callable[[str, DataFrame], DataFrame] = lambda _, rows: rows) -> dict[str, DataFrame]:
    """The typed tables of a snapshot. keep may write a table, or what several are made from (whose names begin with _), and give back what reads it."""
    if inputs.old_ministries and not inputs.laws:
        raise ValueError("old ministries need laws")
    if inputs.succession and not inputs.old_ministries:
        raise ValueError("a table of succession needs old ministries")
    if unknown := sorted(set(inputs.recorded) - set(SOURCES)):
        raise ValueError(f"unknown sources: {unknown}")
    read = readers.plain_corporations if inputs.plain_register else readers.corporations
    out = _Kept(keep)
    register = keep("_register", records.deduplicated_organizations(read(spark, inputs.corporations)))
    reference = readers.commented(spark, inputs.ministries, ["ministry_code", "name", "kensei_jun"])
    organs = register.where("kind_code = '101'")
    named = keep("_named_ministry", resolve.by_unique_name(reference, "name", organs.select(F.col("name").alias("n"), "corp_no"), "n", "corp_no"))
    out["ministry"] = named.where("resolved is not null").select(F.col("resolved").alias("corp_no"), "name", "ministry_code")
    out["unmatched_ministry"] = named.where("resolved is null").select("name", "reason")
    if inputs.laws:
        laws = readers.laws(spark, inputs.laws)
        old = readers.commented(spark, inputs.old_ministries, ["name"]) if inputs.old_ministries else spark.createDataFrame([], "name string")
        out["abolished_organ"] = _abolished(spark, inputs.succession, old, out["ministry"]) if inputs.succession else spark.createDataFrame([], TABLES["abolished_organ"])
        out["jurisdiction_ladder"] = resolve.jurisdictions(laws, out["ministry"], old, out["abolished_organ"])
        ladder = out["jurisdiction_ladder"]
        of = lambda outcome: F.sort_array(F.collect_set(F.when(F.col("outcome") == outcome, F.col("resolved"))))
        own = ladder.groupBy("law_id").agg(of("resolved").alias("jurisdiction"), of("resolved_abolished").alias("abolished_jurisdiction"))
        out["law"] = laws.drop("revision").dropDuplicates(["law_id"]).join(own, "law_id", "left")
        out["law_revision"] = laws.where("revision.enforcement_date is not null").select("law_id", "revision.*").distinct()
    else:
        for n in ("law", "law_revision", "abolished_organ"):
            out[n] = spark.createDataFrame([], TABLES[n])

    keys = ["fiscal_year", "project_id"]
    spine = keep("_spine", records.first(readers.review(spark, inputs.summary, "summary"), ["project_id"], ["row_idx"]))
    year = spine.select("project_id", "fiscal_year")
    of_spine = lambda rows: rows.drop("fiscal_year").join(year, "project_id")
    cited = of_spine(readers.review(spark, inputs.law_citations, "law"))
    laws_cited = resolve.basis_laws(cited, out["law"])
    out["basis_law_citation"] = laws_cited.select("project_id", "fiscal_year", "law_id", "law_title", "resolved", "method", "reason", "key")
    laws_cited = out["basis_law_citation"]
    basis = laws_cited.where("resolved is not null").groupBy("project_id").agg(F.array_sort(F.collect_set("resolved")).alias("basis_law"))
    budget = of_spine(readers.review(spark, inputs.budget, "budget"))
    aggregate = records.aggregate_budget_rows(budget, keys)
    measures = ("initial", "supplementary", "carried_in", "reserve", "available", "executed", "carried_out", "next_year_request")
    out["annual_budget"] = aggregate.select(F.col("fiscal_year").cast("int").alias("fiscal_year"), "project_id", F.col("budget_fiscal_year").cast("int").alias("budget_fiscal_year"), *[T.amount(F.col(m)).alias(m) for m in measures])
    amounts = out["annual_budget"].where("fiscal_year = budget_fiscal_year").select("project_id", F.col("initial").alias("budget_amount"))
    owned = resolve.by_unique_name(spine.withColumn("ministry", T.strip(F.col("ministry"))), "ministry", out["ministry"].select(F.col("name").alias("n"), "corp_no"), "n", "corp_no")
    out["budget_project"] = owned.join(amounts, "project_id", "left").join(basis, "project_id", "left").select(F.col("fiscal_year").cast("int").alias("fiscal_year"), "project_id", "name", F.col("resolved").alias("ministry"), "budget_amount", "basis_law", F.col("ministry").alias("ministry_name"), "reason")

    payees = keep("_payee", of_spine(readers.review(spark, inputs.payees, "payee")))
    lines = records.expenditures(payees)
    found = resolve.recipients(lines, register)
    out["expenditure"] = found.join(year, "project_id").select(F.col("fiscal_year").cast("int").alias("fiscal_year"), "project_id", "seq", F.col("payee").alias("label"), "amount", "recipient", F.col("category").alias("recipient_match_category"), F.when(F.col("category") == "bundled", F.col("payee")).alias("payee_label"), "role", F.nullif(F.col("block_id"), F.lit("")).alias("block_id"), "reason", "method", F.col("corp_no").alias("given_number"))
    if inputs.connections:
        joined = of_spine(readers.review(spark, inputs.connections, "connection"))
        kinds = records.connection_kinds(joined)
        out["expenditure_block"] = records.blocks(records.block_attributes(payees), kinds.where("kind in ('paid', 'edge')")).join(year, "project_id").withColumn("fiscal_year", F.col("fiscal_year").cast("int"))
        out["indirect_cost"] = records.indirect_costs(kinds.where("kind = 'indirect'")).join(year, "project_id").withColumn("fiscal_year", F.col("fiscal_year").cast("int"))
    else:
        out["indirect_cost"] = spark.createDataFrame([], TABLES["indirect_cost"])
        out["expenditure_block"] = records.block_attributes(payees).join(year, "project_id").withColumns({"fiscal_year": F.col("fiscal_year").cast("int"), "paid_by_government": F.lit(False), "funded_by": F.array().cast("array<string>"), "flow_notes": F.array().cast("array<string>")})
    wanted = out["expenditure"].select(F.col("recipient").alias("corp_no")).unionByName(out["ministry"].select("corp_no"))
    out["organization"] = register.join(wanted, "corp_no", "left_semi") if inputs.payees_only else register
    out["unresolved_reference"] = _unresolved(out, laws_cited)
    return out


def _abolished(spark: SparkSession, path: str, old: DataFrame, ministries: DataFrame) -> DataFrame:
    """Abolished organs: old ministries that the law's table has, with the current ministries that their new names lead to."""
    document = spark.read.text(path, wholetext=True).first()["value"]
    rows = succession.succession_rows(spark.createDataFrame([succession.law_document(document, path)], "law_id string, tree string")).where("not dropped").select("row_index", "old_name", "new_name")
    matched = resolve.old_ministries(rows.select("row_index", "old_name"), old)
    current = resolve.successors(rows.select(F.col("new_name").alias("name")).distinct(), ministries.select("name")).select(F.col("name").alias("new_name"), "successor")
    pairs = matched.join(rows, "row_index").join(current, "new_name").select(F.col("target").alias("name"), "successor")
    return succession.abolished(pairs, ministries, succession.abolition_date(document))


def _unresolved(t: dict[str, DataFrame], cited: DataFrame) -> DataFrame:
    """(iri, text, reason, key, unresolved_for) of what was tried and not found."""
    year, pid = F.col("fiscal_year"), F.col("project_id")
    p = t["budget_project"].where("reason is not null and ministry_name <> ''")
    rows = p.select(iri.unresolved_project_ministry(year, pid, F.col("ministry_name")).alias("iri"), F.col("ministry_name").alias("text"), "reason", F.col("ministry_name").alias("key"), iri.project(year, pid).alias("unresolved_for"))
    c = cited.where("reason is not null")
    rows = rows.unionByName(c.select(iri.unresolved_basis_law(year, pid, F.col("key")).alias("iri"), F.col("key").alias("text"), "reason", "key", iri.project(year, pid).alias("unresolved_for")))
    e = t["expenditure"].where("reason is not null")
    rows = rows.unionByName(e.select(iri.unresolved_recipient(year, pid, F.col("seq"), F.col("label")).alias("iri"), F.col("label").alias("text"), "reason", F.col("label").alias("key"), iri.expenditure(year, pid, F.col("seq")).alias("unresolved_for")))
    if "jurisdiction_ladder" in t:
        j = t["jurisdiction_ladder"].where("outcome in ('AMBIGUOUS', 'OLD_MINISTRY', 'OBSOLETE_ORGANIZATION', 'NO_CANDIDATE')")
        rows = rows.unionByName(j.select(iri.unresolved_jurisdiction(F.col("law_id"), F.col("name")).alias("iri"), F.col("name").alias("text"), F.col("outcome").alias("reason"), F.col("name").alias("key"), iri.law(F.col("law_id")).alias("unresolved_for")))
    return rows.distinct()


def quads_of(t: dict[str, DataFrame], date: str) -> DataFrame:
    """All tables as quads, each source in a graph of its own with the date it was fetched on."""
    day = F.lit(date).cast("date")
    graph = {s: iri.graph(F.lit(s), day) for s in GRAPHS}
    year, pid = F.col("fiscal_year"), F.col("project_id")
    project, block = iri.project(year, pid), iri.block(year, pid, F.col("block_id"))
    money = graph["rs-system"]
    made = Q.emit(t["organization"], iri.organization(F.col("corp_no")), ["Organization"], graph["houjin-bangou"], {"corporateNumber": F.col("corp_no"), "prefectureName": F.nullif(F.col("prefecture"), F.lit("")), "cityName": F.nullif(F.col("city"), F.lit(""))}, label=F.col("name"))
    made = made.unionByName(Q.emit(t["ministry"], iri.organization(F.col("corp_no")), ["Ministry"], graph["ministry-codes"], {"corporateNumber": F.col("corp_no"), "ministryCode": F.nullif(F.col("ministry_code"), F.lit(""))}))
    made = made.unionByName(Q.emit(t["abolished_organ"], iri.abolished_organ(F.col("name")), ["AbolishedGovernmentOrgan"], graph["egov-law-data"], {"abolitionDate": F.col("abolition_date").cast("string")}, {"succeededBy": F.transform("succeeded_by", iri.organization)}, label=F.col("name")))
    made = made.unionByName(Q.emit(t["law"], iri.law(F.col("law_id")), ["Law"], graph["egov-law"], {"lawNum": F.col("law_num"), "promulgationDate": F.col("promulgation_date").cast("string")}, {"jurisdiction": F.concat(F.transform("jurisdiction", iri.organization), F.transform("abolished_jurisdiction", iri.abolished_organ))}, label=F.col("law_title")))
    r = {"enforcementDate": F.col("enforcement_date").cast("string"), "amendmentLawNum": F.nullif(F.col("amendment_law_num"), F.lit("")), "revisionStatus": F.col("status")}
    made = made.unionByName(Q.emit(t["law_revision"], iri.law_revision(F.col("law_id"), F.col("enforcement_date"), F.col("amendment_law_num")), ["LawRevision"], graph["egov-law"], r, {"revisionOf": iri.law(F.col("law_id"))}))
    made = made.unionByName(Q.emit(t["budget_project"], project, ["BudgetProject"], money, {"projectId": pid, "fiscalYear": year, "budgetAmount": F.col("budget_amount")}, {"ministry": F.when(F.col("ministry").isNotNull(), iri.organization(F.col("ministry"))), "basisLaw": F.transform("basis_law", iri.law)}, label=F.col("name")))
    e = {"amount": F.col("amount"), "fiscalYear": year, "recipientMatchCategory": F.col("recipient_match_category"), "payeeLabel": F.col("payee_label")}
    made = made.unionByName(Q.emit(t["expenditure"], iri.expenditure(year, pid, F.col("seq")), ["Expenditure"], money, e, {"project": project, "recipient": F.when(F.col("recipient").isNotNull(), iri.organization(F.col("recipient"))), "inBlock": F.when(F.col("block_id").isNotNull(), block)}, label=F.col("label")))
    b = {"blockId": F.col("block_id"), "fiscalYear": year, "amount": F.col("amount"), "paidByGovernment": F.col("paid_by_government").cast("string")}
    a = {"fiscalYear": year, "budgetFiscalYear": F.col("budget_fiscal_year"), **{name: F.col(c) for c, name in MEASURES.items()}}
    made = made.unionByName(Q.emit(t["annual_budget"], iri.annual_budget(year, pid, F.col("budget_fiscal_year")), ["AnnualBudget"], money, a, {"project": project}))
    made = made.unionByName(Q.emit(t["indirect_cost"], iri.indirect_cost(year, pid, F.col("item")), ["IndirectCost"], money, {"fiscalYear": year, "amount": F.col("amount")}, {"project": project}, label=F.col("item")))
    funded = F.transform("funded_by", lambda s: F.concat(project, F.lit("/block/"), iri.quote(s)))
    made = made.unionByName(Q.emit(t["expenditure_block"], block, ["ExpenditureBlock"], money, b, {"project": project, "fundedBy": funded}, label=F.nullif(F.col("block_name"), F.lit(""))))
    u = t["unresolved_reference"]
    return made.unionByName(Q.emit(u, F.col("iri"), ["UnresolvedReference"], money, {"text": F.col("text"), "reason": F.col("reason")}, {"unresolvedFor": F.col("unresolved_for")}))


def _named(prefix: str, column: str, values: tuple[str, ...]) -> dict[str, Column]:
    return {f"{prefix}_{v.lower()}": F.col(column) == v for v in values}


def _counters() -> dict[str, dict[str, Column]]:
    """What the report counts of each table, besides its rows."""
    has = lambda c: F.col(c).isNotNull()
    category, number = F.col("recipient_match_category"), F.col("given_number")
    untried = category == "sentinel_or_nonexistent_houjin_bangou"
    outcomes = ("resolved", "AMBIGUOUS", "resolved_abolished", "OLD_MINISTRY", "OBSOLETE_ORGANIZATION", "NO_CANDIDATE", "EXTRACTION_FAILED")
    return {
        "organization": {"government_organs": F.col("kind_code") == "101", "organizations_without_name": F.coalesce("name", F.lit("")) == "", "organizations_without_place": F.coalesce("prefecture", F.lit("")) == ""},
        "ministry": {"ministries_with_code": F.coalesce("ministry_code", F.lit("")) != ""},
        "unmatched_ministry": _named("ministry", "reason", ("AMBIGUOUS", "NO_CANDIDATE")),
        "abolished_organ": {"abolished_organs_with_successor": F.size("succeeded_by") > 0},
        "law": {"laws_with_jurisdiction": F.size("jurisdiction") > 0, "laws_with_abolished_jurisdiction": F.size("abolished_jurisdiction") > 0, "laws_without_number": F.coalesce("law_num", F.lit("")) == ""},
        "jurisdiction_ladder": _named("jurisdiction", "outcome", outcomes),
        "law_revision": {"revisions_without_amendment": F.coalesce("amendment_law_num", F.lit("")) == ""},
        "basis_law_citation": {"basis_law_resolved": has("resolved"), **_named("basis_law_by", "method", ("law_id", "title_raw", "title_stripped")), **_named("basis_law", "reason", ("AMBIGUOUS", "NO_CANDIDATE")), "basis_law_out_of_scope": F.col("resolved").isNull() & F.col("reason").isNull()},
        "budget_project": {"projects_with_ministry": has("ministry"), "projects_without_ministry": F.col("ministry").isNull(), "projects_with_amount": has("budget_amount"), "projects_without_amount": F.col("budget_amount").isNull(), "projects_with_law": F.size("basis_law") > 0},
        "annual_budget": {"annual_budgets_with_initial": has("initial"), "annual_budgets_executed": has("executed"), "annual_budgets_of_own_year": F.col("fiscal_year") == F.col("budget_fiscal_year"), "annual_budgets_with_request": has("next_year_request")},
        "expenditure": {**_named("recipient", "recipient_match_category", MATCH_CATEGORIES), "recipient_sentinel": untried & number.isin(*SENTINELS), "recipient_nonexistent_number": untried & ~number.isin(*SENTINELS), **_named("recipient_by", "method", ("houjin_bangou", "name")), **_named("recipient", "reason", ("AMBIGUOUS", "NO_CANDIDATE")), "expenditures_without_block": F.col("block_id").isNull(), "expenditures_without_amount": F.col("amount").isNull()},
        "expenditure_block": {"blocks_paid_by_government": F.col("paid_by_government"), "blocks_funded_by_blocks": F.size("funded_by") > 0, "blocks_without_amount": F.col("amount").isNull()},
        "indirect_cost": {"indirect_costs_without_item": F.coalesce("item", F.lit("")) == ""},
        "unresolved_reference": _named("unresolved", "reason", UNRESOLVED_REASONS),
    }


def _write_counted(rows: DataFrame, name: str, path: str) -> dict[str, int]:
    """Writes a table; its counters are observed by the job that writes it."""
    seen = Observation()
    wanted = {"rows": F.lit(True), **_counters().get(name, {})}
    rows.observe(seen, *[F.count(F.when(c, 1)).alias(n) for n, c in wanted.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def provenance_of(quads: DataFrame, inputs: Inputs, dates: dict[str, str] | None = None) -> DataFrame:
    """Quads that say of each graph where it comes from, in a graph of their own. dates has those of graphs of an earlier release."""
    spark = quads.sparkSession
    dates = dict.fromkeys(GRAPHS, inputs.date) | (dates or {})
    rows = spark.createDataFrame([(s, SOURCES[s].name, SOURCES[s].licence, dates[s], inputs.recorded.get(s)) for s in GRAPHS], "source string, name string, licence string, generated_on string, recorded_on string")
    rows = rows.withColumn("g", iri.graph(F.col("source"), F.col("generated_on").cast("date"))).join(quads.select("g").distinct(), "g", "left_semi")
    values = {"sourceName": F.col("name"), "license": F.col("licence"), "generatedOn": F.col("generated_on"), "recordedOn": F.col("recorded_on")}
    return Q.emit(rows, F.col("g"), ["GraphProvenance"], F.lit(PROVENANCE), values)


# Carry-over: a graph whose source, and all that it depends on, are as they were in an earlier release is taken from there.


def _files(inputs: Inputs) -> dict[str, list[str]]:
    """The files of each source."""
    by = {"houjin-bangou": [inputs.corporations], "ministry-codes": [inputs.ministries], "egov-law": [inputs.laws], "egov-law-data": [inputs.old_ministries, inputs.succession], "rs-system": [inputs.summary, inputs.budget, inputs.law_citations, inputs.payees, inputs.connections]}
    return {source: [f for f in files if f] for source, files in by.items()}


def digests(spark: SparkSession, inputs: Inputs) -> dict[str, list[str]]:
    """SHA-256 of the content of each source's files, taken where they are read; a file is one value, so it must be under 2 GB."""
    files = _files(inputs)
    rows = spark.read.format("binaryFile").load(sorted({f for x in files.values() for f in x})).select(F.col("path"), F.sha2("content", 256).alias("sha256")).collect()
    return {source: sorted(r["sha256"] for r in rows if any(r["path"].split(":", 1)[-1].lstrip("/").startswith(f.split(":", 1)[-1].lstrip("/")) for f in own)) for source, own in files.items()}


def _address(spark: SparkSession, source: str, date: str) -> str:
    return spark.range(1).select(iri.graph(F.lit(source), F.lit(date).cast("date"))).first()[0]


def shipped(spark: SparkSession, folder: str) -> dict:
    """What a build that passed its gate says of itself: the date and the digests of each source, and what it was asked to do."""
    said = pointer.latest(spark, f"{folder}/shipped")
    if said is None:
        raise FileNotFoundError(f"{folder} was never shipped: no build there passed its gate")
    return said


def carried(spark: SparkSession, inputs: Inputs, now: dict[str, list[str]], previous: str) -> dict[str, tuple[str, str]]:
    """(date, graph) by source of what may be taken from the release at previous. That it isn't what its manifest declares raises.

    A graph is taken if its source and all that it depends on have the same files, the release has it, and it still has no violation of a
    shape: carrying over spares building a graph, not checking it.
    """
    said = shipped(spark, previous)
    quads = spark.read.parquet(f"{previous}/quads")
    declared = spark.read.parquet(f"{previous}/manifest")
    if not release.verify(quads, declared).isEmpty():
        raise ValueError(f"the quads of {previous} aren't what its manifest declares")
    if said["options"] != _options(inputs):
        return {}
    graphs = {_address(spark, s, d): (s, d) for s, d in said["dates"].items()}
    there = {r["g"] for r in declared.select("g").collect()}  # a row for each graph of a release
    files = "source string, date string, sha256 array<string>"
    rows = release.carried_over(
        spark.createDataFrame([(s, None, x) for s, x in now.items() if x], files).drop("date"), spark.createDataFrame([(s, said["dates"][s], x) for s, x in said["sha256"].items()], files).withColumn("date", F.col("date").cast("date")),
        spark.createDataFrame([(s, n) for s, needed in NEEDS.items() for n in needed if now[n] or said["sha256"].get(n)], "source string, needed string"), spark.createDataFrame([(s, g in there) for g, (s, _) in graphs.items()], "source string, intact boolean"),
    )
    alike = {r["source"] for r in rows.where("carried").collect()}
    wanted = {g: (s, d) for g, (s, d) in graphs.items() if s in alike}
    wrong = {r["g"] for r in validate.violations(quads.where(F.col("g").isin(*wanted))).select("g").distinct().collect()} if wanted else set()
    return {s: (d, g) for g, (s, d) in wanted.items() if g not in wrong}


def _options(inputs: Inputs) -> dict:
    return {"payees_only": inputs.payees_only}


def build(spark: SparkSession, inputs: Inputs, out: str, allow_partial: bool = False, previous: str | None = None) -> Built:
    """Writes tables, the quads of passing graphs, where these come from, their manifest, failing graphs apart, and the report below out.

    Tables are made from those written before, and what several are made from lies in work, so no source is read twice.

    Raises if the gate refuses; the report is written before, and what passes is marked as shipped after. With the folder of an earlier build as previous,
    graphs whose sources didn't change are taken from it, with the date they had.
    """
    now = digests(spark, inputs)
    taken = carried(spark, inputs, now, previous) if previous else {}
    rows, counted = {}, {}

    def keep(name: str, made: DataFrame) -> DataFrame:
        path = f"{out}/work/{name[1:]}" if name.startswith("_") else f"{out}/tables/{name}"
        seen = _write_counted(made, name, path)
        n = seen.pop("rows")
        if not name.startswith("_"):
            rows[name] = n
        counted.update(seen)
        return spark.read.schema(made.schema).parquet(path)

    t = dict(tables(spark, inputs, keep))
    own = quads_of(t, inputs.date)
    if taken:
        own = own.where(~F.col("g").isin(*[_address(spark, s, inputs.date) for s in taken]))
        own = own.unionByName(spark.read.parquet(f"{previous}/quads").where(F.col("g").isin(*[g for _, g in taken.values()])))
    own.distinct().write.mode("overwrite").parquet(f"{out}/quads_before_checks")
    quads = spark.read.parquet(f"{out}/quads_before_checks")
    found = validate.violations(quads)
    found.write.mode("overwrite").parquet(f"{out}/violations")
    found = spark.read.parquet(f"{out}/violations")
    validate.passing(quads, found).write.mode("overwrite").partitionBy("g").parquet(f"{out}/quads")
    clean = spark.read.schema(TABLES["quads"]).parquet(f"{out}/quads")
    gate = validate.Gate()
    gate.add("shape_violations", found)
    gate.checked["shape_violations"] = quads.where(F.col("p") == Q.TYPE).count()
    gate.add("uncovered_classes", validate.uncovered_classes(quads, {**validate.SHAPES, "Ministry": {}}))
    gate.add("broken_references", validate.broken_references(clean))
    gate.checked["broken_references"] = clean.where((F.col("o_kind") != Q.LITERAL) & (F.col("p") != Q.TYPE)).count()
    gate.add("block_sums", validate.block_sums(t["expenditure_block"], t["expenditure"]), F.col("wrong"))
    gate.add("annual_identities", validate.annual_identities(t["annual_budget"]), F.col("wrong"))
    gate.add("project_amounts", validate.project_amounts(t["budget_project"], t["annual_budget"]), F.col("wrong"))
    told = t["expenditure"].groupBy("recipient_match_category").agg(F.count("*").alias("n")).withColumnRenamed("recipient_match_category", "category")
    inferred = F.when(F.col("recipient").isNotNull(), "resolved").when(F.col("payee_label").isNotNull(), "bundled").when(F.col("reason").isNotNull(), "unresolved").otherwise("sentinel_or_nonexistent_houjin_bangou")
    again = t["expenditure"].groupBy(inferred.alias("category")).agg(F.count("*").alias("n"))
    recount = lambda rows: rows.groupBy().agg(F.count("*").alias("n")).select(F.lit("abolished").alias("kind"), "n")
    linked = clean.where((F.col("p") == iri.term("core", "jurisdiction")) & F.col("o").startswith(f"{iri.BASE}/id/org/abolished/")).select("s", "o").distinct()
    named = t["law"].select("law_id", F.explode("abolished_jurisdiction").alias("name")).distinct()
    gate.add("abolished_jurisdictions", validate.count_mismatches(recount(named), recount(linked), ["kind"]))
    gate.add("category_counts", validate.count_mismatches(told, again, ["category"]))
    if gate.faults["shape_violations"]:
        validate.quarantined(quads, found, f"{out}/quarantine/{inputs.date}-{uuid4().hex[:8]}")
    dates = {s: d for s, (d, _) in taken.items()}
    provenance_of(clean, inputs, dates).write.mode("overwrite").parquet(f"{out}/provenance")
    release.manifest(clean).write.mode("overwrite").parquet(f"{out}/manifest")
    report = {"date": inputs.date, "faults": gate.faults, "checked": gate.checked, "counters": counted, "rows": rows, "carried_over": {s: g for s, (_, g) in taken.items()}}
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    messages = gate.close(allow_partial, ("shape_violations", "broken_references"))
    pointer.advance(spark, f"{out}/shipped", {"dates": {s: dates.get(s, inputs.date) for s in GRAPHS}, "sha256": {s: x for s, x in now.items() if x}, "options": _options(inputs)})
    return Built(t, clean, found, gate, messages, spark.read.parquet(f"{out}/provenance"))
