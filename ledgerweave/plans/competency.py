"""The competency questions: what the knowledge graph must be able to answer.

A parameter (an entity, a date) is an argument with a default that exists in the driver's tables at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iri
from ..operators import quads as Q
from .catalog import query
from .harness import Harness

LAW, MINISTRY, RECIPIENT = "L11", "0000000000003", "0000000001001"


@query(f"""SELECT j.organ, o.name AS organ_name, CASE WHEN o.abolished THEN o.successor END AS successor, CASE WHEN o.abolished THEN s.name END AS successor_name
FROM jurisdiction j JOIN organ o ON j.organ = o.corp_no LEFT JOIN organ s ON o.abolished AND o.successor = s.corp_no AND s.name IS NOT NULL WHERE j.law_id = '{LAW}' AND o.name IS NOT NULL""")
def cq01_jurisdiction_of_law(t: Harness, law: str = LAW) -> DataFrame:
    """Who is in charge of a law, and of an abolished organ its successor."""
    organ = t.organ.where("name is not null")
    return _with_successor(t.jurisdiction.where(F.col("law_id") == law).join(organ, F.col("organ") == F.col("corp_no")), t).select("organ", F.col("name").alias("organ_name"), F.when(F.col("abolished"), F.col("successor")).alias("successor"), "successor_name")


def _with_successor(rows: DataFrame, t: Harness) -> DataFrame:
    names = t.organ.where("name is not null").select(F.col("corp_no").alias("_s"), F.col("name").alias("_n"))
    return rows.join(names, F.col("abolished") & (F.col("successor") == F.col("_s")), "left").withColumn("successor_name", F.col("_n")).drop("_s", "_n")


@query(f"SELECT fiscal_year, CAST(sum(budget_amount) AS BIGINT) AS total_budget, count(*) AS projects FROM project WHERE ministry = '{MINISTRY}' AND budget_amount IS NOT NULL GROUP BY fiscal_year")
def cq02_ministry_budget_by_year(t: Harness, ministry: str = MINISTRY) -> DataFrame:
    rows = t.project.where((F.col("ministry") == ministry) & F.col("budget_amount").isNotNull())
    return rows.groupBy("fiscal_year").agg(F.sum("budget_amount").alias("total_budget"), F.count("*").alias("projects")).orderBy("fiscal_year")


@query(f"SELECT e.project_id, p.name, e.fiscal_year, e.seq, e.amount FROM expenditure e JOIN project p ON e.project_id = p.project_id WHERE e.recipient = '{RECIPIENT}'")
def cq03_expenditures_of_recipient(t: Harness, recipient: str = RECIPIENT) -> DataFrame:
    rows = t.expenditure.where(F.col("recipient") == recipient).select("project_id", "fiscal_year", "seq", "amount")
    return rows.join(t.project.select("project_id", "name"), "project_id").select("project_id", "name", "fiscal_year", "seq", "amount").orderBy("fiscal_year", "project_id", "seq")


@query(f"""SELECT DISTINCT p.ministry, o.name AS ministry_name, l.law_id, l.title FROM expenditure e JOIN project p ON e.project_id = p.project_id
JOIN organ o ON p.ministry = o.corp_no AND o.name IS NOT NULL JOIN jurisdiction j ON j.organ = p.ministry JOIN law l ON j.law_id = l.law_id WHERE e.recipient = '{RECIPIENT}'""")
def cq04_money_trace(t: Harness, recipient: str = RECIPIENT) -> DataFrame:
    """From a recipient to ministries and their laws. The ministries are made distinct before laws multiply them."""
    projects = t.expenditure.where(F.col("recipient") == recipient).select("project_id").distinct()
    ministries = t.project.join(projects, "project_id", "left_semi").select("ministry").distinct()
    named = ministries.join(t.organ.where("name is not null").select(F.col("corp_no").alias("ministry"), F.col("name").alias("ministry_name")), "ministry")
    return named.join(t.jurisdiction, F.col("organ") == F.col("ministry")).join(t.law.select("law_id", "title"), "law_id").select("ministry", "ministry_name", "law_id", "title").distinct()


@query("""SELECT pl.law_id, p.project_id, p.ministry, m.name AS ministry_name, o.corp_no AS issuing_organ, o.name AS issuing_organ_name, CASE WHEN o.abolished AND s.name IS NOT NULL THEN o.successor END AS successor, s.name AS successor_name
FROM project p JOIN project_law pl ON p.project_id = pl.project_id JOIN organ m ON p.ministry = m.corp_no AND m.name IS NOT NULL
LEFT JOIN (SELECT j.law_id, organ.* FROM jurisdiction j JOIN organ ON j.organ = organ.corp_no AND organ.name IS NOT NULL) o ON pl.law_id = o.law_id
LEFT JOIN organ s ON o.abolished AND o.successor = s.corp_no AND s.name IS NOT NULL""")
def cq05_ministry_of_basis_law(t: Harness) -> DataFrame:
    """The ministry of a project beside the organ that issued its basis law, with that organ's successor."""
    named = t.organ.where("name is not null")
    issuing = _with_successor(t.jurisdiction.join(named, F.col("organ") == F.col("corp_no")), t)
    issuing = issuing.select("law_id", F.col("corp_no").alias("issuing_organ"), F.col("name").alias("issuing_organ_name"), F.when(F.col("successor_name").isNotNull(), F.col("successor")).alias("successor"), "successor_name")
    rows = t.project.where("ministry is not null").select("project_id", "ministry").join(named.select(F.col("corp_no").alias("ministry"), F.col("name").alias("ministry_name")), "ministry").join(t.project_law, "project_id")
    return rows.join(issuing, "law_id", "left").select("law_id", "project_id", "ministry", "ministry_name", "issuing_organ", "issuing_organ_name", "successor", "successor_name")


@query("SELECT project_id, category, count(*) AS n FROM expenditure GROUP BY project_id, category")
def cq06_unresolved_recipients_per_project(t: Harness) -> DataFrame:
    return t.expenditure.groupBy("project_id", "category").agg(F.count("*").alias("n")).orderBy("project_id", "category")


@query("SELECT DISTINCT r.g, v.source_name, v.generated_on FROM revision r JOIN provenance v ON r.g = v.g WHERE r.law_id = 'L11'")
def cq07_provenance_of_edge(t: Harness, law: str = LAW) -> DataFrame:
    graphs = t.revision.where(F.col("law_id") == law).select("g").distinct()
    return graphs.join(t.provenance, "g").select("g", "source_name", "generated_on")


@query("""SELECT law_id, d, amendment, g FROM (SELECT r.*, row_number() OVER (PARTITION BY r.law_id ORDER BY r.d DESC, r.amendment DESC, r.g) AS n FROM revision r JOIN provenance v ON r.g = v.g WHERE r.d <= v.generated_on) WHERE n = 1""")
def cq08_law_revision_as_of(t: Harness) -> DataFrame:
    """The revision of each law in force when its graph was made; on one day the amendment decides."""
    rows = t.revision.join(t.provenance.select("g", "generated_on"), "g").where("d <= generated_on")
    order = Window.partitionBy("law_id").orderBy(F.desc("d"), F.desc("amendment"), "g")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("law_id", "d", "amendment", "g")


@query("""SELECT law_id, 'resolved' AS status, organ AS detail FROM jurisdiction
UNION ALL SELECT law_id, CASE WHEN reason IN ('OLD_MINISTRY', 'OBSOLETE_ORGANIZATION') THEN 'unresolved_old_or_obsolete_ministry' ELSE 'unresolved_other' END, reason FROM unresolved""")
def cq09_jurisdiction_resolution_status(t: Harness) -> DataFrame:
    done = t.jurisdiction.select("law_id", F.lit("resolved").alias("status"), F.col("organ").alias("detail"))
    status = F.when(F.col("reason").isin("OLD_MINISTRY", "OBSOLETE_ORGANIZATION"), "unresolved_old_or_obsolete_ministry").otherwise("unresolved_other")
    return done.unionByName(t.unresolved.select("law_id", status.alias("status"), F.col("reason").alias("detail")))


@query("SELECT source_name, generated_on AS as_of, CASE WHEN recorded_on IS NOT NULL THEN '記録日' ELSE '取得日' END AS date_kind FROM provenance")
def cq10_release_freshness(t: Harness) -> DataFrame:
    return t.provenance.select("source_name", F.col("generated_on").alias("as_of"), F.when(F.col("recorded_on").isNotNull(), "記録日").otherwise("取得日").alias("date_kind")).orderBy("source_name")


@query("""SELECT j.law_id, j.organ, o.name AS organ_name, CASE WHEN s.name IS NOT NULL THEN o.successor END AS successor, s.name AS successor_name
FROM jurisdiction j JOIN organ o ON j.organ = o.corp_no LEFT JOIN organ s ON o.successor = s.corp_no AND s.name IS NOT NULL WHERE o.abolished AND o.name IS NOT NULL""")
def cq11_succession_of_abolished(t: Harness) -> DataFrame:
    rows = _with_successor(t.jurisdiction.join(t.organ.where("abolished and name is not null"), F.col("organ") == F.col("corp_no")), t)
    return rows.select("law_id", "organ", F.col("name").alias("organ_name"), F.when(F.col("successor_name").isNotNull(), F.col("successor")).alias("successor"), "successor_name")


@query("""SELECT fiscal_year, CAST(sum(amount) AS BIGINT) AS government_paid, count(*) AS items FROM
(SELECT fiscal_year, amount FROM block WHERE paid UNION ALL SELECT fiscal_year, amount FROM indirect) GROUP BY fiscal_year""")
def cq12_government_paid_total(t: Harness) -> DataFrame:
    """What the government itself pays out: entry blocks and indirect costs."""
    return t.paid_items.groupBy("fiscal_year").agg(F.sum("amount").alias("government_paid"), F.count("*").alias("items")).orderBy("fiscal_year")


@query("""SELECT b.project_id, p.name, b.block_id, b.block_name, b.paid, b.amount, f.source_id, s.block_name AS source_name FROM block b JOIN funding f ON b.project_id = f.project_id AND b.block_id = f.block_id
JOIN block s ON f.project_id = s.project_id AND f.source_id = s.block_id JOIN project p ON p.project_id = b.project_id ORDER BY b.amount DESC, b.project_id, b.block_id, f.source_id LIMIT 20""")
def cq13_money_through_stages(t: Harness) -> DataFrame:
    """The 20 largest amounts that pass from one stage to the next; the project breaks ties."""
    sources = t.kept_block.select("project_id", F.col("block_id").alias("source_id"), F.col("block_name").alias("source_name"))
    passed = t.kept_block.join(t.kept_funding.join(sources.select("project_id", "source_id"), ["project_id", "source_id"], "left_semi"), ["project_id", "block_id"])
    first = passed.orderBy(F.desc("amount"), "project_id", "block_id", "source_id").limit(20)
    top = sources.join(F.broadcast(first), ["project_id", "source_id"])  # 20 rows
    rows = top.join(t.project.select("project_id", "name"), "project_id").select("project_id", "name", "block_id", "block_name", "paid", "amount", "source_id", "source_name")
    return rows.orderBy(F.desc("amount"), "project_id", "block_id", "source_id")


@query("""SELECT sheet_year, budget_year, CAST(sum(initial) AS BIGINT) AS initial, CAST(sum(supplementary) AS BIGINT) AS supplementary, CAST(sum(carried_in) AS BIGINT) AS carried_in, CAST(sum(reserve) AS BIGINT) AS reserve,
CAST(sum(available) AS BIGINT) AS available, CAST(sum(executed) AS BIGINT) AS executed, count(*) AS projects FROM annual WHERE reserve IS NOT NULL GROUP BY sheet_year, budget_year""")
def cq14_budget_and_execution(t: Harness) -> DataFrame:
    """Sums of all measures; a project with a missing one isn't in any of them."""
    measures = ["initial", "supplementary", "carried_in", "reserve", "available", "executed"]
    return t.annual.dropna(subset=measures).groupBy("sheet_year", "budget_year").agg(*[F.sum(m).alias(m) for m in measures], F.count("*").alias("projects")).orderBy("sheet_year", "budget_year")


@query("""SELECT p.ministry, o.name, p.fiscal_year, CAST(sum(p.budget_amount) AS BIGINT) AS total_budget, count(DISTINCT p.project_id) AS projects
FROM project p LEFT JOIN organ o ON p.ministry = o.corp_no WHERE p.ministry IS NOT NULL AND p.budget_amount IS NOT NULL GROUP BY p.ministry, o.name, p.fiscal_year""")
def cq15_ministry_budget_ranking(t: Harness) -> DataFrame:
    """Budgets of ministries by year, the largest first. Names come after the aggregation, for one row per ministry and year."""
    rows = t.project.where("ministry is not null and budget_amount is not null").groupBy("ministry", "fiscal_year").agg(F.sum("budget_amount").alias("total_budget"), F.count_distinct("project_id").alias("projects"))
    named = rows.join(t.organ.select(F.col("corp_no").alias("ministry"), "name"), "ministry", "left")
    return named.select("ministry", "name", "fiscal_year", "total_budget", "projects").orderBy(F.desc("total_budget"))


@query("SELECT budget_year, CAST(sum(next_request) AS BIGINT) AS requested, CAST(sum(initial) AS BIGINT) AS initial, count(*) AS records FROM annual WHERE next_request IS NOT NULL GROUP BY budget_year")
def cq16_request_vs_initial(t: Harness) -> DataFrame:
    """Requests beside initial budgets of one year; the two aren't paired by project, see cq20."""
    rows = t.annual.dropna(subset=["next_request", "initial"])
    return rows.groupBy("budget_year").agg(F.sum("next_request").alias("requested"), F.sum("initial").alias("initial"), F.count("*").alias("records")).orderBy("budget_year")


@query("SELECT category, CAST(sum(amount) AS BIGINT) AS total_amount, count(*) AS expenditures FROM expenditure GROUP BY category")
def cq17_recipient_identification(t: Harness) -> DataFrame:
    return t.expenditure.groupBy("category").agg(F.sum("amount").alias("total_amount"), F.count("*").alias("expenditures")).orderBy(F.desc("total_amount"))


@query("""SELECT 'Organ' AS type, count(*) AS instances FROM organ UNION ALL SELECT 'AbolishedGovernmentOrgan', count(*) FROM organ WHERE abolished UNION ALL SELECT 'Organization', count(*) FROM organization
UNION ALL SELECT 'Law', count(*) FROM law UNION ALL SELECT 'BudgetProject', count(*) FROM project""")
def cq18_kg_scale(t: Harness) -> DataFrame:
    """Instances by type over the set union of graphs: organs are in two graphs and count once."""
    typed = lambda rows, key, kind, g: rows.select(F.col(key).cast("string").alias("s"), F.lit(Q.TYPE).alias("p"), F.lit(iri.term("core", kind)).alias("o"), F.lit(g).alias("g"))
    made = typed(t.organ, "corp_no", "Organ", "ministry").unionByName(typed(t.organ, "corp_no", "Organ", "corporation")).unionByName(typed(t.organ.where("abolished"), "corp_no", "AbolishedGovernmentOrgan", "succession"))
    made = made.unionByName(typed(t.organization, "corp_no", "Organization", "corporation")).unionByName(typed(t.law, "law_id", "Law", "law")).unionByName(typed(t.project, "project_id", "BudgetProject", "budget"))
    return Q.type_counts(made).orderBy(F.desc("instances"))


@query("SELECT fiscal_year, CAST(sum(amount) AS BIGINT) AS naive_sum, CAST(sum(CASE WHEN paid THEN amount ELSE 0 END) AS BIGINT) AS entry_only, count(*) AS blocks FROM block GROUP BY fiscal_year")
def cq19_naive_sum_vs_entry_only(t: Harness) -> DataFrame:
    """Adding all blocks counts money once for every stage; entry blocks alone don't."""
    entry = F.when(F.col("paid"), F.col("amount")).otherwise(F.lit(0).cast("bigint"))
    return t.block.groupBy("fiscal_year").agg(F.sum("amount").alias("naive_sum"), F.sum(entry).alias("entry_only"), F.count("*").alias("blocks")).orderBy("fiscal_year")


@query("""SELECT a.budget_year AS request_year, CAST(sum(a.next_request) AS BIGINT) AS requested_both, CAST(sum(b.initial) AS BIGINT) AS initial_both, count(*) AS projects_in_both, CAST(sum(CASE WHEN a.next_request = b.initial THEN 1 ELSE 0 END) AS BIGINT) AS exact_matches
FROM annual a JOIN annual b ON a.project_id = b.project_id AND b.budget_year = a.budget_year + 1 WHERE a.next_request IS NOT NULL GROUP BY a.budget_year""")
def cq20_request_exactly_granted(t: Harness) -> DataFrame:
    """Requests and what the next year's budget granted, by project. The shifted year is a join key, so it is a hash or merge join."""
    asked = t.annual.where("next_request is not null").select("project_id", F.col("budget_year").alias("request_year"), (F.col("budget_year") + 1).alias("budget_year"), "next_request")
    both = asked.join(t.annual.select("project_id", "budget_year", "initial"), ["project_id", "budget_year"])
    exact = F.sum(F.when(F.col("next_request") == F.col("initial"), 1).otherwise(0))
    return both.groupBy("request_year").agg(F.sum("next_request").alias("requested_both"), F.sum("initial").alias("initial_both"), F.count("*").alias("projects_in_both"), exact.alias("exact_matches")).orderBy("request_year")


@query("SELECT project_id, category, count(*) AS n FROM expenditure GROUP BY project_id, category")
def legacy_cq06_inferred_category(t: Harness) -> DataFrame:
    """The category inferred from what an expenditure has or lacks: recipient, payee label, unresolved reference. An oracle for cq06 that doesn't read it."""
    keys = ["project_id", "seq"]
    e = t.expenditure
    recipient = e.where("recipient is not null").select(*keys, F.lit(True).alias("_recipient"))
    label = e.where("l_suppkey % 7 <> 0 and block_id = 'A'").select(*keys, F.lit(True).alias("_label"))
    reference = e.where("l_suppkey % 7 <> 0 and block_id = 'R'").select(*keys, F.lit(True).alias("_reference"))
    rows = e.select(*keys).join(recipient, keys, "left").join(label, keys, "left").join(reference, keys, "left")
    category = F.when(F.col("_recipient"), "resolved").when(F.col("_reference"), "unresolved").when(F.col("_label"), "bundled").otherwise("sentinel_or_nonexistent_houjin_bangou")
    return rows.groupBy("project_id", category.alias("category")).agg(F.count("*").alias("n")).orderBy("project_id", "category")


@query("SELECT corp_no, name, kind_code, prefecture, city FROM organization WHERE corp_no = '0000000001001'")
def p0_01_organization_lookup(t: Harness, corp_no: str = RECIPIENT) -> DataFrame:
    return t.organization.where(F.col("corp_no") == corp_no)


@query("SELECT corp_no, name, successor FROM organ")
def p0_02_ministry_list(t: Harness) -> DataFrame:
    return t.organ.select("corp_no", "name", "successor").orderBy("corp_no")


@query("SELECT DISTINCT r.law_id, r.g, v.source_name FROM revision r JOIN provenance v ON r.g = v.g")
def p0_03_provenance_of_all_edges(t: Harness) -> DataFrame:
    return t.revision.select("law_id", "g").distinct().join(t.provenance.select("g", "source_name"), "g").select("law_id", "g", "source_name")


@query("SELECT source_name, max(generated_on) AS last_on FROM provenance GROUP BY source_name")
def p0_04_release_freshness(t: Harness) -> DataFrame:
    return t.provenance.groupBy("source_name").agg(F.max("generated_on").alias("last_on")).orderBy("source_name")


@query("SELECT reason, count(*) AS n FROM unresolved GROUP BY reason")
def p0_05_unresolved_count(t: Harness) -> DataFrame:
    return t.unresolved.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT o.corp_no, o.name FROM organization o WHERE NOT EXISTS (SELECT 1 FROM expenditure e WHERE e.recipient = o.corp_no)")
def p0_06_organizations_without_number(t: Harness) -> DataFrame:
    """Organizations that nothing refers to by number."""
    return t.organization.join(t.expenditure.select(F.col("recipient").alias("corp_no")), "corp_no", "left_anti").select("corp_no", "name")


@query("""SELECT corp_no AS ministry, name, corp_no, CASE WHEN CAST(corp_no AS INTEGER) % 3 <> 0 THEN 'K' || CAST(CAST(corp_no AS INTEGER) AS VARCHAR) END AS ministry_code FROM organ WHERE name IS NOT NULL AND NOT abolished ORDER BY name""")
def p0_02_ministries_by_name(t: Harness) -> DataFrame:
    """Ministries by name with their numbers, and their codes where these are known: a ministry without a code stays."""
    quads = _ministry_quads(t)
    codes = quads.where(F.col("p") == iri.term("core", "ministryCode")).select("s", F.col("o").alias("ministry_code"))
    numbers = quads.where(F.col("p") == iri.term("core", "corporateNumber")).select("s", F.col("o").alias("corp_no"))
    named = Q.labels(quads).where("label is not null and not described").select("s", F.col("label").alias("name"))
    rows = Q.specific_types(quads).where("type = 'Ministry'").join(named, "s").join(numbers, "s").join(codes, "s", "left")
    return rows.select(F.col("s").alias("ministry"), "name", "corp_no", "ministry_code").orderBy("name")


def _ministry_quads(t: Harness) -> DataFrame:
    """Organs that aren't abolished as ministries; those whose key divides by three have no code."""
    key = F.col("corp_no").cast("int")
    code = F.when(key % 3 != 0, F.concat(F.lit("K"), key.cast("string")))
    return Q.emit(t.organ.where("not abolished"), F.col("corp_no"), ["Ministry"], F.lit("ministry"), {"corporateNumber": F.col("corp_no"), "ministryCode": code}, label=F.col("name"))


@query("SELECT corp_no AS s, kind FROM (SELECT corp_no, CASE WHEN kind_code = '101' THEN 'GovernmentOrgan' ELSE 'Organization' END AS kind FROM organization WHERE CAST(corp_no AS BIGINT) % 9 = 0 AND CAST(corp_no AS BIGINT) % 2 = 0)")
def p0_06_without_corporate_number(t: Harness) -> DataFrame:
    """Organizations of any class that no graph gives a number: the number of every ninth is left out of its own graph, and of these every other is in a second graph."""
    key, kind = F.col("corp_no").cast("long"), F.when(F.col("kind_code") == "101", "GovernmentOrgan").otherwise("Organization")
    number = F.struct(F.lit(iri.term("core", "corporateNumber")).alias("p"), F.col("corp_no").alias("o"))
    typed = F.struct(F.lit(Q.TYPE).alias("p"), F.concat(F.lit(iri.term("core", "")), kind).alias("o"))
    own = t.organization.select(F.col("corp_no").alias("s"), F.explode(F.array_compact(F.array(typed, F.when(key % 9 != 0, number)))).alias("q"), F.lit("register").alias("g"))
    second = t.organization.where(key % 2 == 1).select(F.col("corp_no").alias("s"), number.alias("q"), F.lit("review").alias("g"))
    quads = own.unionByName(second).select("s", "q.*", "g")
    organizations = quads.where((F.col("p") == Q.TYPE) & F.col("o").isin(*[iri.term("core", k) for k in ("Organization", "GovernmentOrgan", "Ministry")]))
    numbered = quads.where(F.col("p") == iri.term("core", "corporateNumber")).select("s")
    return organizations.join(numbered, "s", "left_anti").select("s", iri.local_name(F.col("o")).alias("kind")).distinct()
