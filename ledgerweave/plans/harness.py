"""The driver's tables as the classes of this engine, in Spark and, for the oracle, in SQL.

Keys that are multiples of small primes are taken as missing, unresolved or wrong, alike on both sides, so that outer and anti joins
and checks have something to find.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lineage import cut
from ..operators.records import numbered


def number(c: Column) -> Column:
    """A corporate number of 13 digits."""
    return F.lpad(c.cast("string"), 13, "0")


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


#: Law numbers of all forms, told apart by the law's key modulo their number.
LAW_NUMBERS = (
    "昭和二十六年大蔵省令第十号", "平成十二年総理府・大蔵省令第三号", "令和元年政令第五号", "人事院規則一〇―七", "平成二十年財務省令第九号", "平成十五年運輸委令第一号",
    "令和三年法律第八号", "規則第一号", "平成十三年内閣府令第二号", "大正三年逓信省令第四号の二", "昭和五年海軍軍令部令第七号",
)
CURRENT, OLD, ABOLISHED = (("財務省", "M1"), ("人事院", "M2"), ("内閣府", "M3"), ("内閣府", "M4")), ("大蔵省", "総理府", "海軍軍令部"), ("大蔵省",)

_LIST = ", ".join(f"'{x}'" for x in LAW_NUMBERS)
PRELUDE = f"""
WITH organ AS (
  SELECT lpad(CAST(n_nationkey AS VARCHAR), 13, '0') AS corp_no, CASE WHEN n_nationkey % 7 <> 0 THEN n_name END AS name, n_nationkey % 4 = 3 AS abolished,
         CASE WHEN n_nationkey % 8 = 3 THEN lpad(CAST(n_nationkey + 1 AS VARCHAR), 13, '0') END AS successor, n_regionkey AS region FROM nation),
organization AS (
  SELECT lpad(CAST(s_suppkey + 1000 AS VARCHAR), 13, '0') AS corp_no, s_name AS name, CASE s_nationkey % 3 WHEN 0 THEN '101' WHEN 1 THEN '301' ELSE '201' END AS kind_code,
         'P' || CAST(s_nationkey AS VARCHAR) AS prefecture, 'C' || CAST(s_suppkey % 10 AS VARCHAR) AS city FROM supplier),
project AS MATERIALIZED (
  SELECT o_orderkey AS project_id, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, 'project ' || CAST(o_orderkey AS VARCHAR) AS name, o_custkey AS owner,
         CASE WHEN o_orderkey % 11 <> 0 THEN lpad(CAST(c_nationkey AS VARCHAR), 13, '0') END AS ministry,
         CASE WHEN o_orderkey % 13 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS budget_amount,
         'L' || CAST(o_orderkey % 211 AS VARCHAR) AS law_a, CASE WHEN o_orderkey % 5 = 0 THEN 'L' || CAST(o_custkey % 97 AS VARCHAR) END AS law_b
  FROM orders JOIN customer ON o_custkey = c_custkey),
project_law AS (SELECT project_id, law_a AS law_id FROM project UNION SELECT project_id, law_b FROM project WHERE law_b IS NOT NULL),
line AS MATERIALIZED (
  SELECT l_orderkey AS project_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS seq,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, l_suppkey, l_returnflag, l_linestatus, l_tax, l_extendedprice, l_linenumber, l_partkey FROM lineitem),
expenditure AS MATERIALIZED (
  SELECT line.project_id, project.fiscal_year, seq, amount, l_returnflag AS block_id, l_suppkey,
         CASE WHEN l_suppkey % 7 = 0 THEN 'sentinel_or_nonexistent_houjin_bangou' WHEN l_returnflag = 'A' THEN 'bundled' WHEN l_returnflag = 'R' THEN 'unresolved' ELSE 'resolved' END AS category,
         CASE WHEN l_suppkey % 7 <> 0 AND l_returnflag NOT IN ('A', 'R') THEN lpad(CAST(l_suppkey + 1000 AS VARCHAR), 13, '0') END AS recipient
  FROM line JOIN project ON line.project_id = project.project_id),
block AS MATERIALIZED (
  SELECT project_id, fiscal_year, block_id, CASE WHEN project_id % 5 <> 0 THEN 'block ' || block_id END AS block_name, CAST(sum(amount) AS BIGINT) + CASE WHEN project_id % 101 = 0 THEN 1 ELSE 0 END AS amount, count(*) AS payees, min(seq) = 0 AS paid
  FROM expenditure GROUP BY project_id, fiscal_year, block_id),
funding AS (SELECT b.project_id, b.block_id, s.block_id AS source_id FROM block b JOIN block s ON b.project_id = s.project_id AND s.block_id < b.block_id),
indirect AS (
  SELECT line.project_id, fiscal_year, 'item ' || CAST(l_linenumber AS VARCHAR) AS item, CAST(sum(CAST(round(l_extendedprice * l_tax * 100) AS BIGINT)) AS BIGINT) AS amount
  FROM line JOIN project ON line.project_id = project.project_id WHERE l_tax > 0 GROUP BY line.project_id, fiscal_year, l_linenumber),
yearly AS (
  SELECT o_custkey AS project_id, CAST(year(o_orderdate) AS INTEGER) AS budget_year, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS initial,
         CAST(sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS supplementary,
         CAST(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS carried_in,
         CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS executed FROM orders GROUP BY o_custkey, year(o_orderdate)),
annual AS (
  SELECT a.project_id, 2001 AS sheet_year, a.budget_year, a.initial, a.supplementary, a.carried_in, CASE WHEN a.project_id % 9 <> 0 THEN CAST(a.project_id % 1000 AS BIGINT) END AS reserve,
         a.initial + a.supplementary + a.carried_in + a.project_id % 1000 + CASE WHEN a.project_id % 17 = 0 THEN 1 ELSE 0 END AS available, a.executed,
         CASE WHEN a.project_id % 3 = 0 THEN coalesce(b.initial, a.supplementary) WHEN a.project_id % 7 <> 0 THEN a.supplementary END AS next_request
  FROM yearly a LEFT JOIN yearly b ON a.project_id = b.project_id AND b.budget_year = a.budget_year + 1),
law AS (
  SELECT 'L' || CAST(p_partkey AS VARCHAR) AS law_id, p_partkey, p_name AS title, ([{_LIST}])[CAST(p_partkey % {len(LAW_NUMBERS)} + 1 AS INTEGER)] AS law_num FROM part),
jurisdiction AS (
  SELECT 'L' || CAST(p_partkey AS VARCHAR) AS law_id, lpad(CAST(p_partkey % 25 AS VARCHAR), 13, '0') AS organ FROM part WHERE p_partkey % 6 <> 0
  UNION SELECT 'L' || CAST(p_partkey AS VARCHAR), lpad(CAST((p_partkey + 3) % 25 AS VARCHAR), 13, '0') FROM part WHERE p_partkey % 10 = 1),
unresolved AS (
  SELECT 'L' || CAST(p_partkey AS VARCHAR) AS law_id, CASE p_partkey % 24 WHEN 0 THEN 'OLD_MINISTRY' WHEN 6 THEN 'OBSOLETE_ORGANIZATION' WHEN 12 THEN 'NO_CANDIDATE' ELSE 'AMBIGUOUS' END AS reason FROM part WHERE p_partkey % 6 = 0),
revision AS (SELECT DISTINCT 'L' || CAST(user_id AS VARCHAR) AS law_id, CAST(ts AS DATE) AS d, event_type AS g, CAST(event_id % 3 AS VARCHAR) AS amendment FROM events),
provenance AS (
  SELECT DISTINCT event_type AS g, CAST('2024-01-10' AS DATE) + CAST(length(event_type) AS INTEGER) AS generated_on, upper(event_type) AS source_name, CASE WHEN event_type IN ('click', 'view') THEN CAST('2024-01-31' AS DATE) END AS recorded_on FROM events WHERE event_type <> 'error'),
edge AS (
  SELECT 'P' || CAST(project_id AS VARCHAR) AS src, ministry AS dst, 'ministry' AS predicate FROM project WHERE ministry IS NOT NULL
  UNION ALL SELECT 'P' || CAST(project_id AS VARCHAR), law_id, 'basisLaw' FROM project_law
  UNION ALL SELECT law_id, organ, 'jurisdiction' FROM jurisdiction)
"""


_schemas: dict[str, StructType] = {}


class Harness:
    """The same tables as PRELUDE names them, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        """A table; its schema is read from the files once for each path, not for each query."""
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _schemas:
            _schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[path]).parquet(path)

    def views(self) -> list[str]:
        """Temporary views of all tables, for questions in SQL; returns their names."""
        names = [n for n, v in vars(type(self)).items() if isinstance(v, cached_property) and not n.startswith("kept_")]
        for n in names:
            getattr(self, n).createOrReplaceTempView(n)
        return names

    @cached_property
    def organ(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.raw("nation").select(number(k).alias("corp_no"), F.when(k % 7 != 0, F.col("n_name")).alias("name"), (k % 4 == 3).alias("abolished"), F.when(k % 8 == 3, number(k + 1)).alias("successor"), F.col("n_regionkey").alias("region"))

    @cached_property
    def organization(self) -> DataFrame:
        k, n = F.col("s_suppkey"), F.col("s_nationkey")
        kind = F.when(n % 3 == 0, "101").when(n % 3 == 1, "301").otherwise("201")
        return self.raw("supplier").select(number(k + 1000).alias("corp_no"), F.col("s_name").alias("name"), kind.alias("kind_code"), F.concat(F.lit("P"), n.cast("string")).alias("prefecture"), F.concat(F.lit("C"), (k % 10).cast("string")).alias("city"))

    @cached_property
    def project(self) -> DataFrame:
        k = F.col("o_orderkey")
        rows = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        law = lambda c: F.concat(F.lit("L"), c.cast("string"))
        return rows.select(k.alias("project_id"), F.year("o_orderdate").alias("fiscal_year"), F.concat(F.lit("project "), k.cast("string")).alias("name"), F.col("o_custkey").alias("owner"), F.when(k % 11 != 0, number(F.col("c_nationkey"))).alias("ministry"),
                           F.when(k % 13 != 0, cents(F.col("o_totalprice"))).alias("budget_amount"), law(k % 211).alias("law_a"), F.when(k % 5 == 0, law(F.col("o_custkey") % 97)).alias("law_b"))

    @cached_property
    def year(self) -> DataFrame:
        """(project_id, fiscal_year), without the owners that project joins; every order has one."""
        return self.raw("orders").select(F.col("o_orderkey").alias("project_id"), F.year("o_orderdate").alias("fiscal_year"))

    @cached_property
    def project_law(self) -> DataFrame:
        return self.project.select("project_id", F.explode(F.array_distinct(F.array_compact(F.array("law_a", "law_b")))).alias("law_id"))

    @cached_property
    def line(self) -> DataFrame:
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        rows = numbered(self.raw("lineitem"), ["l_orderkey"], order)
        return rows.select(F.col("l_orderkey").alias("project_id"), "seq", cents(F.col("l_extendedprice")).alias("amount"), "l_suppkey", "l_returnflag", "l_linestatus", "l_tax", "l_extendedprice", "l_linenumber", "l_partkey")

    @cached_property
    def expenditure(self) -> DataFrame:
        k, flag = F.col("l_suppkey"), F.col("l_returnflag")
        category = F.when(k % 7 == 0, "sentinel_or_nonexistent_houjin_bangou").when(flag == "A", "bundled").when(flag == "R", "unresolved").otherwise("resolved")
        rows = self.line.join(self.year, "project_id")
        return rows.select("project_id", "fiscal_year", "seq", "amount", flag.alias("block_id"), "l_suppkey", category.alias("category"), F.when((k % 7 != 0) & ~flag.isin("A", "R"), number(k + 1000)).alias("recipient"))

    @cached_property
    def block(self) -> DataFrame:
        rows = self.expenditure.groupBy("project_id", "fiscal_year", "block_id").agg(F.sum("amount").alias("amount"), F.count("*").alias("payees"), (F.min("seq") == 0).alias("paid"))
        return rows.select("project_id", "fiscal_year", "block_id", F.when(F.col("project_id") % 5 != 0, F.concat(F.lit("block "), "block_id")).alias("block_name"), (F.col("amount") + F.when(F.col("project_id") % 101 == 0, 1).otherwise(0)).alias("amount"), "payees", "paid")

    @cached_property
    def kept_block(self) -> DataFrame:
        """block, computed once for questions that read it again and again; it stays partitioned by project."""
        return cut(self.block)

    @cached_property
    def kept_funding(self) -> DataFrame:
        sources = self.kept_block.select("project_id", F.col("block_id").alias("source_id"))
        return self.kept_block.select("project_id", "block_id").join(sources, "project_id").where("source_id < block_id")

    @cached_property
    def paid_items(self) -> DataFrame:
        """(fiscal_year, amount) of entry blocks and of indirect costs, from one pass over the lines: a line counts for its block, and with a tax for its item too."""
        line = self.line.join(self.year, "project_id")
        key = lambda kind, name, amount, seq: F.struct(F.lit(kind).alias("kind"), name.alias("key"), amount.alias("amount"), seq.alias("seq"))
        both = F.array(key("block", F.col("l_returnflag"), F.col("amount"), F.col("seq")), F.when(F.col("l_tax") > 0, key("indirect", F.col("l_linenumber").cast("string"), cents(F.col("l_extendedprice") * F.col("l_tax")), F.lit(0))))
        rows = line.select("project_id", "fiscal_year", F.explode(F.array_compact(both)).alias("x")).groupBy("project_id", "fiscal_year", "x.kind", "x.key").agg(F.sum("x.amount").alias("amount"), F.min("x.seq").alias("seq"))
        off = F.when((F.col("kind") == "block") & (F.col("project_id") % 101 == 0), 1).otherwise(0)
        return rows.where("seq = 0").select("fiscal_year", (F.col("amount") + off).alias("amount"))

    @cached_property
    def funding(self) -> DataFrame:
        sources = self.block.select("project_id", F.col("block_id").alias("source_id"))
        return self.block.select("project_id", "block_id").join(sources, "project_id").where("source_id < block_id")

    @cached_property
    def indirect(self) -> DataFrame:
        rows = self.line.where("l_tax > 0").join(self.year, "project_id")
        made = rows.groupBy("project_id", "fiscal_year", "l_linenumber").agg(F.sum(cents(F.col("l_extendedprice") * F.col("l_tax"))).alias("amount"))
        return made.select("project_id", "fiscal_year", F.concat(F.lit("item "), F.col("l_linenumber").cast("string")).alias("item"), "amount")

    @cached_property
    def yearly(self) -> DataFrame:
        amount = cents(F.col("o_totalprice"))
        part = lambda c: F.sum(F.when(c, amount).otherwise(F.lit(0).cast("bigint")))
        rows = self.raw("orders").groupBy(F.col("o_custkey").alias("project_id"), F.year("o_orderdate").alias("budget_year"))
        return rows.agg(F.sum(amount).alias("initial"), part(F.col("o_orderpriority") == "3-MEDIUM").alias("supplementary"), part(F.col("o_orderstatus") == "P").alias("carried_in"), part(F.col("o_orderstatus") == "F").alias("executed"))

    @cached_property
    def annual(self) -> DataFrame:
        k = F.col("project_id")
        after = self.yearly.select("project_id", (F.col("budget_year") - 1).alias("budget_year"), F.col("initial").alias("_next"))
        rows = self.yearly.join(after, ["project_id", "budget_year"], "left")
        request = F.when(k % 3 == 0, F.coalesce("_next", "supplementary")).when(k % 7 != 0, F.col("supplementary"))
        available = F.col("initial") + F.col("supplementary") + F.col("carried_in") + k % 1000 + F.when(k % 17 == 0, 1).otherwise(0)
        return rows.select("project_id", F.lit(2001).alias("sheet_year"), "budget_year", "initial", "supplementary", "carried_in", F.when(k % 9 != 0, k % 1000).alias("reserve"), available.alias("available"), "executed", request.alias("next_request"))

    @cached_property
    def law(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(F.concat(F.lit("L"), k.cast("string")).alias("law_id"), "p_partkey", F.col("p_name").alias("title"), F.element_at(F.array(*[F.lit(x) for x in LAW_NUMBERS]), (k % len(LAW_NUMBERS) + 1).cast("int")).alias("law_num"))

    @cached_property
    def jurisdiction(self) -> DataFrame:
        k = F.col("p_partkey")
        organs = F.array_distinct(F.array_compact(F.array(F.when(k % 6 != 0, number(k % 25)), F.when(k % 10 == 1, number((k + 3) % 25)))))
        return self.raw("part").select(F.concat(F.lit("L"), k.cast("string")).alias("law_id"), F.explode(organs).alias("organ"))

    @cached_property
    def unresolved(self) -> DataFrame:
        k = F.col("p_partkey")
        reason = F.when(k % 24 == 0, "OLD_MINISTRY").when(k % 24 == 6, "OBSOLETE_ORGANIZATION").when(k % 24 == 12, "NO_CANDIDATE").otherwise("AMBIGUOUS")
        return self.raw("part").where(k % 6 == 0).select(F.concat(F.lit("L"), k.cast("string")).alias("law_id"), reason.alias("reason"))

    @cached_property
    def revision(self) -> DataFrame:
        return self.raw("events").select(F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("law_id"), F.to_date("ts").alias("d"), F.col("event_type").alias("g"), (F.col("event_id") % 3).cast("string").alias("amendment")).distinct()

    @cached_property
    def provenance(self) -> DataFrame:
        rows = self.raw("events").select(F.col("event_type").alias("g")).where("g <> 'error'").distinct()
        return rows.select("g", F.date_add(F.lit("2024-01-10").cast("date"), F.length("g")).alias("generated_on"), F.upper("g").alias("source_name"), F.when(F.col("g").isin("click", "view"), F.lit("2024-01-31").cast("date")).alias("recorded_on"))

    @cached_property
    def edge(self) -> DataFrame:
        """(src, dst, predicate, g)"""
        p = F.concat(F.lit("P"), F.col("project_id").cast("string"))
        made = self.project.where("ministry is not null").select(p.alias("src"), F.col("ministry").alias("dst"), F.lit("ministry").alias("predicate"))
        made = made.unionByName(self.project_law.select(p.alias("src"), F.col("law_id").alias("dst"), F.lit("basisLaw").alias("predicate")))
        made = made.unionByName(self.jurisdiction.select(F.col("law_id").alias("src"), F.col("organ").alias("dst"), F.lit("jurisdiction").alias("predicate")))
        return made.withColumn("g", F.col("predicate"))
