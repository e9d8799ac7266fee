"""Validation, release and set queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import iri
from ..operators import analytics as A
from ..operators import quads as Q
from ..operators import records, release, validate
from ..schema import UNRESOLVED_REASONS
from .catalog import query
from .harness import Harness


def _law_quads(t: Harness, g: str) -> DataFrame:
    """Quads of laws with faults: without a number, with two, or with a predicate that the shape doesn't have."""
    k = F.col("p_partkey")
    at = F.concat(F.lit(f"{iri.BASE}/id/law/"), F.col("law_id"))
    values = {"lawNum": F.when(k % 50 != 0, F.col("law_num")), "nickname": F.when(k % 70 == 1, F.col("title"))}
    made = Q.emit(t.law, at, ["Law"], F.lit(g), values, label=F.col("title"))
    return made.unionByName(Q.emit(t.law.where(k % 90 == 2), at, [], F.lit(g), {"lawNum": F.lit("another")}))


@query("""SELECT law_id, 'lawNum' AS predicate, 'least' AS rule FROM law WHERE p_partkey % 50 = 0 AND p_partkey % 90 <> 2 UNION ALL SELECT law_id, 'lawNum', 'most' FROM law WHERE p_partkey % 90 = 2 AND p_partkey % 50 <> 0
UNION ALL SELECT law_id, 'nickname', 'closed' FROM law WHERE p_partkey % 70 = 1""")
def shape_violations(t: Harness) -> DataFrame:
    return validate.violations(_law_quads(t, "g1")).select(F.substring_index("s", "/", -1).alias("law_id"), "predicate", "rule")


@query("SELECT 'good' AS g, count(*) AS laws FROM law WHERE p_partkey % 50 <> 0 AND p_partkey % 90 <> 2 AND p_partkey % 70 <> 1")
def passing_graphs(t: Harness) -> DataFrame:
    """A graph with a violation is held back whole; another one passes."""
    k = F.col("p_partkey")
    good = Q.emit(t.law.where((k % 50 != 0) & (k % 90 != 2) & (k % 70 != 1)), F.concat(F.lit(f"{iri.BASE}/id/law/good-"), F.col("law_id")), ["Law"], F.lit("good"), {"lawNum": F.col("law_num")})
    quads = good.unionByName(_law_quads(t, "bad"))
    return validate.passing(quads, validate.violations(quads)).groupBy("g").agg(F.count_distinct("s").alias("laws"))


@query("""SELECT law_id, organ, CASE WHEN CAST(organ AS INTEGER) % 5 = 0 THEN 'untyped' ELSE 'wrong_type' END AS reason FROM jurisdiction WHERE CAST(organ AS INTEGER) % 5 IN (0, 1)""")
def broken_references(t: Harness) -> DataFrame:
    """Laws whose organ has no type, or is of a class that isn't an organization; ministries are organizations by the closure."""
    n = F.col("corp_no").cast("int")
    at = F.concat(F.lit(f"{iri.BASE}/id/org/"), F.col("corp_no"))
    typed = Q.emit(t.organ.where(n % 5 > 1), at, ["Ministry"], F.lit("org")).unionByName(Q.emit(t.organ.where(n % 5 == 1), at, ["Law"], F.lit("org")))
    links = Q.emit(t.jurisdiction, F.concat(F.lit(f"{iri.BASE}/id/law/"), F.col("law_id")), ["Law"], F.lit("law"), links={"jurisdiction": F.concat(F.lit(f"{iri.BASE}/id/org/"), F.col("organ"))})
    found = validate.broken_references(typed.unionByName(links))
    return found.select(F.substring_index("s", "/", -1).alias("law_id"), F.substring_index("o", "/", -1).alias("organ"), "reason")


@query("SELECT b.project_id, b.block_id, b.amount, CAST(sum(e.amount) AS BIGINT) AS total, b.amount <> CAST(sum(e.amount) AS BIGINT) AS wrong FROM block b JOIN expenditure e ON b.project_id = e.project_id AND b.block_id = e.block_id GROUP BY b.project_id, b.block_id, b.amount")
def block_sum_invariant(t: Harness) -> DataFrame:
    return validate.block_sums(t.block, t.expenditure).select("project_id", "block_id", "amount", "total", "wrong")


@query("SELECT project_id, budget_year, initial + supplementary + carried_in + reserve <> available AS wrong FROM annual WHERE reserve IS NOT NULL")
def annual_identity_invariant(t: Harness) -> DataFrame:
    return validate.annual_identities(t.annual).select("project_id", "budget_year", "wrong")


@query("""SELECT y.project_id, y.budget_year, y.initial + CASE WHEN y.project_id % 19 = 0 THEN 5 ELSE 0 END AS budget_amount, y.project_id % 19 = 0 AS wrong FROM yearly y WHERE y.project_id % 4 <> 0""")
def project_amount_invariant(t: Harness) -> DataFrame:
    k = F.col("project_id")
    projects = t.yearly.select(F.col("budget_year").alias("fiscal_year"), "project_id", (F.col("initial") + F.when(k % 19 == 0, 5).otherwise(0)).alias("budget_amount"))
    annual = t.annual.where(k % 4 != 0).withColumn("budget_fiscal_year", F.col("budget_year"))
    return validate.project_amounts(projects, annual).select("project_id", F.col("fiscal_year").alias("budget_year"), "budget_amount", "wrong")


@query("""SELECT project_id, category, n + CASE WHEN project_id % 23 = 0 THEN 1 ELSE 0 END AS n_left, n AS n_right FROM (SELECT project_id, category, count(*) AS n FROM expenditure GROUP BY project_id, category) WHERE project_id % 23 = 0 AND category <> 'bundled'
UNION ALL SELECT project_id, category, CAST(0 AS BIGINT), count(*) FROM expenditure WHERE category = 'bundled' GROUP BY project_id, category""")
def category_count_mismatches(t: Harness) -> DataFrame:
    """Two independent counts; one of them is off for some projects and lacks a category."""
    n = t.expenditure.groupBy("project_id", "category").agg(F.count("*").alias("n"))
    off = n.where("category <> 'bundled'").withColumn("n", F.col("n") + F.when(F.col("project_id") % 23 == 0, 1).otherwise(0))
    return validate.count_mismatches(off, n, ["project_id", "category"]).select("project_id", "category", "n_left", "n_right")


@query("""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN executed = 0 THEN 'no-denominator' WHEN paid = 0 THEN 'zero' WHEN paid = executed THEN '1' WHEN paid = 2 * executed THEN '2' WHEN paid = 3 * executed THEN '3' ELSE 'other' END AS bucket
FROM (SELECT executed, executed * (project_id % 5) AS paid FROM yearly)) GROUP BY bucket""")
def payment_ratio_histogram(t: Harness) -> DataFrame:
    return A.ratio_buckets(t.yearly.select("executed", (F.col("executed") * (F.col("project_id") % 5)).alias("paid")))


@query("SELECT r.reason, count(u.reason) AS n FROM (VALUES ('AMBIGUOUS'), ('NO_CANDIDATE'), ('OBSOLETE_ORGANIZATION'), ('OLD_MINISTRY'), ('NONE')) r(reason) LEFT JOIN unresolved u ON r.reason = u.reason GROUP BY r.reason")
def zero_filled_reasons(t: Harness) -> DataFrame:
    return A.zero_filled(t.unresolved.groupBy("reason").agg(F.count("*").alias("n")), "reason", (*UNRESOLVED_REASONS, "NONE"))


@query("SELECT count(*) FILTER (amount > 5000000) AS large, count(*) FILTER (recipient IS NULL) AS without_recipient, count(*) FILTER (category = 'bundled') AS bundled, count(*) FILTER (seq = 0) AS first_rows FROM expenditure")
def observed_counters(t: Harness) -> DataFrame:
    return records.counters(t.expenditure, large=F.col("amount") > 5_000_000, without_recipient=F.col("recipient").isNull(), bundled=F.col("category") == "bundled", first_rows=F.col("seq") == 0)


_PART = "SELECT g, part[1:{0}] AS part, sum(n) AS n, sha256(string_agg(part || ' ' || d, chr(10) ORDER BY part || ' ' || d)) AS d FROM {1} GROUP BY g, part[1:{0}]"


@query(f""", line AS MATERIALIZED (SELECT DISTINCT predicate AS g, sha256(src || ' ' || dst) AS d FROM edge), six AS (SELECT g, d[1:6] AS part, count(*) AS n, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM line GROUP BY g, d[1:6]),
four AS ({_PART.format(4, "six")}), two AS ({_PART.format(2, "four")}) SELECT g, CAST(n AS BIGINT) AS n, d AS digest FROM ({_PART.format(0, "two")})""".replace("line AS MATERIALIZED", "told AS MATERIALIZED").replace("FROM line GROUP", "FROM told GROUP"))
def graph_digests(t: Harness) -> DataFrame:
    """Digests of graphs by parts of parts of their lines."""
    return release.graph_digests(t.edge.select("g", F.concat("src", F.lit(" "), "dst").alias("value")).distinct())


@query("SELECT * FROM (VALUES ('basisLaw', 'changed'), ('jurisdiction', 'same'), ('ministry', 'removed'), ('new', 'added')) x(g, change)", prelude=False)
def release_difference(t: Harness) -> DataFrame:
    """Two releases of the edges by digests of their graphs: one graph changed, one gone, one new."""
    lines = t.edge.select("g", F.concat("src", F.lit(" "), "dst").alias("value"))
    after = lines.where("g <> 'ministry' and not (g = 'basisLaw' and value like '%7')").unionByName(lines.where("g = 'ministry'").withColumn("g", F.lit("new")))
    return release.difference(release.graph_digests(lines), release.graph_digests(after))


@query("SELECT src, dst, predicate FROM edge WHERE predicate = 'ministry'")
def undeclared_graphs(t: Harness) -> DataFrame:
    declared = t.spark.createDataFrame([("basisLaw",), ("jurisdiction",)], "g string")
    return release.undeclared(t.edge, declared).select("src", "dst", "predicate")


@query("""WITH changed AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_custkey % 500 = 3)
SELECT n_name AS source, n_nationkey NOT IN (SELECT k FROM changed) AND (n_nationkey + 1) % 25 NOT IN (SELECT k FROM changed) AND n_nationkey % 10 <> 4 AS carried FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""", prelude=False)
def carried_over_graphs(t: Harness) -> DataFrame:
    """Two snapshots of customers with a file for each nation and segment: a nation depends on itself and the next one; some customers changed, and some nations aren't intact in the earlier release."""
    nations = t.raw("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("source"))
    customers = t.raw("customer").join(nations, F.col("c_nationkey") == F.col("k"))
    value = F.concat_ws(" ", "c_custkey", "c_name")

    def files(changed: bool) -> DataFrame:
        text = F.when(F.lit(changed) & (F.col("c_custkey") % 500 == 3), F.concat(value, F.lit(" anew"))).otherwise(value)
        parts = release.graph_digests(customers.select(F.concat_ws("|", "source", "c_mktsegment").alias("g"), text.alias("value")))
        return parts.groupBy(F.substring_index("g", "|", 1).alias("source")).agg(F.collect_list("digest").alias("sha256"))

    after = nations.select(((F.col("k") + 24) % 25).alias("k"), F.col("source").alias("needed"))
    needs = nations.select("source", F.col("source").alias("needed")).unionByName(nations.join(after, "k").select("source", "needed"))
    shipped = nations.select("source", (F.col("k") % 10 != 4).alias("intact"))
    return release.carried_over(files(True), files(False).withColumn("date", F.lit("2024-01-01").cast("date")), needs, shipped).select("source", "carried")


@query("SELECT corp_no FROM organ WHERE corp_no NOT IN (SELECT ministry FROM project WHERE ministry IS NOT NULL) OR corp_no IN (SELECT organ FROM jurisdiction)")
def set_difference_and_intersection(t: Harness) -> DataFrame:
    organs = t.organ.select("corp_no")
    return organs.subtract(t.project.select("ministry")).unionByName(organs.intersect(t.jurisdiction.select(F.col("organ").alias("corp_no")))).distinct()


@query("SELECT law_id, count(DISTINCT g) AS n_values, count(*) AS n_rows FROM revision GROUP BY law_id HAVING count(DISTINCT g) > 1")
def unstable_keys(t: Harness) -> DataFrame:
    return release.multi_valued(t.revision, ["law_id"], "g")


@query("SELECT DISTINCT 'p' || CAST(page_id AS VARCHAR) AS source, url AS iri FROM pages WHERE NOT contains(url, '.example.com')", prelude=False)
def stray_addresses(t: Harness) -> DataFrame:
    """Addresses of pages outside the hosts that the pages themselves are of, but for one domain."""
    texts = t.raw("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source"), F.col("url").alias("text"))
    found = validate.stray_addresses(texts, [])
    return found.where(~F.col("iri").contains(".example.com"))


@query("SELECT DISTINCT recipient AS corp_no FROM expenditure WHERE recipient IS NOT NULL")
def payee_scope(t: Harness) -> DataFrame:
    """Of all corporations those that something was paid to."""
    return t.organization.join(t.expenditure.select(F.col("recipient").alias("corp_no")), "corp_no", "left_semi").select("corp_no")


@query("SELECT law_id, law_num, title FROM law")
def nquads_round_trip(t: Harness) -> DataFrame:
    """Laws written as lines of N-Quads and read back."""
    quads = Q.emit(t.law, F.concat(F.lit(f"{iri.BASE}/id/law/"), F.col("law_id")), ["Law"], F.lit("g"), {"lawNum": F.col("law_num")}, label=F.concat(F.lit('"'), F.col("title"), F.lit("\\\n")))
    back = Q.parsed(quads.select(Q.line().alias("value")), ["g"])
    text = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    rows = back.groupBy(F.substring_index("s", "/", -1).alias("law_id")).agg(text(iri.term("core", "lawNum")).alias("law_num"), text(Q.LABEL).alias("label"))
    return rows.select("law_id", "law_num", F.expr("substring(label, 2, length(label) - 3)").alias("title"))


@query("""SELECT ministry, fiscal_year, CAST(sum(budget_amount) AS BIGINT) AS total, grouping_id(ministry, fiscal_year) AS level FROM project WHERE ministry IS NOT NULL AND budget_amount IS NOT NULL GROUP BY ROLLUP (ministry, fiscal_year)""")
def budget_rollup(t: Harness) -> DataFrame:
    return A.budget_rollup(t.project.where("ministry is not null and budget_amount is not null"), "budget_amount", ["ministry", "fiscal_year"])
