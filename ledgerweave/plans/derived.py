"""Search, graph and display queries, resolution ladders and scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import iri
from ..functions import text as T
from ..operators import analytics as A
from ..operators import freshness, graph, records, resolve
from ..operators import quads as Q
from ..sources import lake
from ..streaming import usage
from .catalog import query
from .harness import ABOLISHED, CURRENT, OLD, Harness

CENTER = "0000000000003"
_GIVEN = "(VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in CURRENT) + ") m(name, corp_no)"


def _named(t: Harness, values: tuple, schema: str) -> DataFrame:
    return t.spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


# Search and entities


@query("""SELECT id, type, label FROM (SELECT corp_no AS id, 'Organization' AS type, name AS label FROM organization UNION ALL SELECT law_id, 'Law', title FROM law UNION ALL SELECT CAST(project_id AS VARCHAR), 'BudgetProject', name FROM project)
WHERE contains(lower(label), 'ring') ORDER BY label, id LIMIT 20""")
def search_entities(t: Harness) -> DataFrame:
    entities = t.organization.select(F.col("corp_no").alias("id"), F.lit("Organization").alias("type"), F.col("name").alias("label")).unionByName(t.law.select(F.col("law_id").alias("id"), F.lit("Law").alias("type"), F.col("title").alias("label")))
    entities = entities.unionByName(t.project.select(F.col("project_id").cast("string").alias("id"), F.lit("BudgetProject").alias("type"), F.col("name").alias("label")))
    return Q.search(entities, "RING", 20).select("id", "type", "label")


@query("""SELECT corp_no AS id, prefecture || city AS summary FROM organization UNION ALL SELECT law_id, law_num FROM law
UNION ALL SELECT CAST(p.project_id AS VARCHAR), CASE WHEN o.name IS NULL THEN CAST(fiscal_year AS VARCHAR) || '年度' ELSE CAST(fiscal_year AS VARCHAR) || '年度・' || o.name END FROM project p LEFT JOIN organ o ON p.ministry = o.corp_no""")
def entity_summaries(t: Harness) -> DataFrame:
    none = F.lit(None).cast("string")
    year = F.lit(None).cast("int")
    a = t.organization.select(F.col("corp_no").alias("id"), T.summary(F.lit("Organization"), none, F.col("prefecture"), F.col("city"), year, none).alias("summary"))
    b = t.law.select(F.col("law_id").alias("id"), T.summary(F.lit("Law"), F.col("law_num"), none, none, year, none).alias("summary"))
    named = t.project.join(t.organ.select(F.col("corp_no").alias("ministry"), F.col("name").alias("m")), "ministry", "left")
    c = named.select(F.col("project_id").cast("string").alias("id"), T.summary(F.lit("BudgetProject"), none, none, none, F.col("fiscal_year"), F.col("m")).alias("summary"))
    return a.unionByName(b).unionByName(c)


@query("""SELECT p.project_id, 'fiscalYear' AS predicate, CAST(fiscal_year AS VARCHAR) AS value, 2 AS graphs FROM project p
UNION ALL SELECT project_id, 'budgetAmount', CAST(budget_amount AS VARCHAR), 1 FROM project WHERE budget_amount IS NOT NULL""")
def entity_attributes(t: Harness) -> DataFrame:
    """Literal values of projects with the number of graphs that state them, through quads."""
    k = F.concat(F.lit(f"{iri.BASE}/id/budget/"), F.col("project_id").cast("string"))
    rows = t.project
    a = Q.emit(rows, k, ["BudgetProject"], F.lit("g1"), {"fiscalYear": F.col("fiscal_year"), "budgetAmount": F.col("budget_amount")}, label=F.col("name"))
    b = Q.emit(rows, k, ["BudgetProject"], F.lit("g2"), {"fiscalYear": F.col("fiscal_year")})
    found = Q.attributes(a.unionByName(b))
    return found.select(F.substring_index("s", "/", -1).cast("bigint").alias("project_id"), "predicate", "value", F.size("graphs").alias("graphs"))


@query("""SELECT id, other_type, count(DISTINCT other) AS entities FROM (SELECT dst AS id, src AS other, CASE WHEN predicate = 'jurisdiction' THEN 'Law' ELSE 'BudgetProject' END AS other_type FROM edge WHERE predicate <> 'basisLaw') GROUP BY id, other_type""")
def entity_relationship_groups(t: Harness) -> DataFrame:
    types = t.law.select(F.col("law_id").alias("s"), F.lit("Law").alias("type")).unionByName(t.project.select(F.concat(F.lit("P"), F.col("project_id").cast("string")).alias("s"), F.lit("BudgetProject").alias("type")))
    _, groups = Q.relationships(t.edge.where("predicate <> 'basisLaw'"), types)
    return groups.join(t.organ.select(F.col("corp_no").alias("id")), "id", "left_semi")


@query("""SELECT s, min_by(type, place) AS type FROM (SELECT corp_no AS s, 'Organization' AS type, 4 AS place FROM organ UNION ALL SELECT corp_no, 'Ministry', 2 FROM organ WHERE name IS NOT NULL UNION ALL SELECT corp_no, 'AbolishedGovernmentOrgan', 1 FROM organ WHERE abolished) GROUP BY s""")
def most_specific_types(t: Harness) -> DataFrame:
    typed = lambda rows, kind: rows.select(F.col("corp_no").alias("s"), F.lit(Q.TYPE).alias("p"), F.lit(iri.term("org", kind)).alias("o"))
    made = typed(t.organ, "Organization").unionByName(typed(t.organ.where("name is not null"), "Ministry")).unionByName(typed(t.organ.where("abolished"), "AbolishedGovernmentOrgan"))
    return Q.specific_types(made)


@query("SELECT r.law_id, r.g, coalesce(v.g IS NOT NULL, false) AS available FROM (SELECT DISTINCT law_id, g FROM revision) r LEFT JOIN provenance v ON r.g = v.g")
def provenance_or_unavailable(t: Harness) -> DataFrame:
    return Q.with_provenance(t.revision.select("law_id", "g").distinct(), t.provenance).select("law_id", "g", "available")


# Graph


@query(f"""SELECT node, direction, predicate, other, n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY direction, predicate, other) AS INTEGER) AS n
FROM (SELECT src AS node, 'outgoing' AS direction, predicate, dst AS other FROM edge UNION ALL SELECT dst, 'incoming', predicate, src FROM edge) WHERE node IN (SELECT corp_no FROM organ)) WHERE n <= 26""")
def expand_capped(t: Harness) -> DataFrame:
    return graph.expand(t.edge, t.organ.select(F.col("corp_no").alias("node")), 25).select("node", "direction", "predicate", "other", "n")


@query(f"SELECT src, dst, predicate FROM (SELECT *, row_number() OVER (ORDER BY predicate, src) AS n FROM edge WHERE dst = '{CENTER}') WHERE n <= 25")
def neighborhood_of_ministry(t: Harness) -> DataFrame:
    """Depth 1 about a ministry, whose edges all come in: the first by predicate and other end up to the fan-out."""
    found = graph.neighborhood(t.edge, CENTER, 1, 100, 200, 25)
    return t.spark.createDataFrame([e[:3] for e in found.edges], "src string, dst string, predicate string")


@query(f"""SELECT node, min(hops) AS hops FROM (SELECT '{CENTER}' AS node, 0 AS hops UNION ALL SELECT src, 1 FROM edge WHERE dst = '{CENTER}'
UNION ALL SELECT b.node, 2 FROM (SELECT src FROM edge WHERE dst = '{CENTER}') a JOIN (SELECT src AS node, dst AS other FROM edge UNION ALL SELECT dst, src FROM edge) b ON a.src = b.other) GROUP BY node""")
def hop_distances(t: Harness) -> DataFrame:
    return graph.hops_from(t.edge, t.organ.where(F.col("corp_no") == CENTER).select(F.col("corp_no").alias("node")), 2)


@query("SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge) GROUP BY node")
def node_degrees(t: Harness) -> DataFrame:
    return graph.degrees(t.edge)


@query("""SELECT b.project_id, b.block_id AS node, CAST(count(f.source_id) AS INTEGER) AS level FROM block b LEFT JOIN funding f ON b.project_id = f.project_id AND b.block_id = f.block_id GROUP BY b.project_id, b.block_id""")
def flow_levels(t: Harness) -> DataFrame:
    """Every earlier block funds the later ones, so the longest path to a block has as many steps as it has sources."""
    links = t.kept_funding.select("project_id", F.col("source_id").alias("src"), F.col("block_id").alias("dst"))
    return graph.flow_levels(links, t.kept_block.select("project_id", F.col("block_id").alias("node")), ["project_id"], 3)


@query("""SELECT dst AS node, count(DISTINCT src) AS hits FROM edge WHERE src IN ('L1', 'L11', 'L21', 'L31', 'L51') AND predicate = 'jurisdiction' GROUP BY dst HAVING count(DISTINCT src) >= 2""")
def search_graph_bridges(t: Harness) -> DataFrame:
    hits = _named(t, ("L1", "L11", "L21", "L31", "L51"), "node string")
    return graph.bridges(t.edge.where("predicate = 'jurisdiction'"), hits)


@query("""SELECT src, dst, predicate FROM edge WHERE predicate = 'jurisdiction'""")
def filtered_graph(t: Harness) -> DataFrame:
    nodes = t.organ.select(F.col("corp_no").alias("id"), F.lit("Organ").alias("type")).unionByName(t.law.select(F.col("law_id").alias("id"), F.lit("Law").alias("type"))).unionByName(t.project.select(F.concat(F.lit("P"), F.col("project_id").cast("string")).alias("id"), F.lit("BudgetProject").alias("type")))
    _, edges = graph.filtered(nodes, t.edge, CENTER, ["Organ", "Law"], ["jurisdiction", "ministry"])
    return edges.select("src", "dst", "predicate")


@query("SELECT corp_no AS id, coalesce(name, 'no name') AS label FROM organ UNION ALL SELECT corp_no, name FROM organization")
def merged_graph_nodes(t: Harness) -> DataFrame:
    a = t.organ.select(F.col("corp_no").alias("id"), F.coalesce("name", F.lit("no name")).alias("label"))
    b = t.organ.select(F.col("corp_no").alias("id"), F.lit("second").alias("label")).unionByName(t.organization.select(F.col("corp_no").alias("id"), F.col("name").alias("label")))
    none = t.edge.limit(0)
    return graph.merged([a, b], [none, none])[0]


# Display


@query("""SELECT ministry, fiscal_year, round(CAST(total AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY fiscal_year) AS DOUBLE) * 100, 6) AS share, rank() OVER (PARTITION BY fiscal_year ORDER BY total DESC) AS place
FROM (SELECT ministry, fiscal_year, CAST(sum(budget_amount) AS BIGINT) AS total FROM project WHERE ministry IS NOT NULL AND budget_amount IS NOT NULL GROUP BY ministry, fiscal_year)""")
def ministry_shares(t: Harness) -> DataFrame:
    rows = t.project.where("ministry is not null and budget_amount is not null").groupBy("ministry", "fiscal_year").agg(F.sum("budget_amount").alias("total"))
    made = A.ranked(A.shares(rows, "total", ["fiscal_year"]), "total", ["fiscal_year"])
    return made.select("ministry", "fiscal_year", F.round("share", 6).alias("share"), F.col("rank").cast("bigint").alias("place"))


@query("""SELECT budget_year, round(CASE WHEN sum(available) > 0 THEN CAST(CAST(sum(executed) AS BIGINT) AS DOUBLE) / CAST(CAST(sum(available) AS BIGINT) AS DOUBLE) * 100 END, 6) AS execution_rate FROM annual WHERE reserve IS NOT NULL GROUP BY budget_year""")
def execution_rates(t: Harness) -> DataFrame:
    rows = t.annual.where("reserve is not null").groupBy("budget_year").agg(F.sum("executed").alias("e"), F.sum("available").alias("a"))
    return rows.select("budget_year", F.round(A.percent(F.col("e"), F.col("a")), 6).alias("execution_rate"))


@query("SELECT min(total) AS least, max(total) AS most FROM (SELECT CAST(sum(amount) AS BIGINT) AS total FROM expenditure GROUP BY fiscal_year, category)")
def total_range(t: Harness) -> DataFrame:
    return A.value_range(t.expenditure.groupBy("fiscal_year", "category").agg(F.sum("amount").alias("total")), "total")


@query("""SELECT project_id, block_id, amount FROM block WHERE project_id IN (SELECT project_id FROM (SELECT DISTINCT project_id FROM block) ORDER BY project_id LIMIT 4)""")
def first_projects(t: Harness) -> DataFrame:
    return A.first_groups(t.block, "project_id", ["project_id", "block_id"], 4).select("project_id", "block_id", "amount")


@query("""SELECT project_id, budget_amount, replace(CASE WHEN budget_amount >= 1000000000000 THEN CAST((budget_amount + 50000000000) // 100000000000 // 10 AS VARCHAR) || '.' || CAST((budget_amount + 50000000000) // 100000000000 % 10 AS VARCHAR) || '兆円'
WHEN budget_amount >= 100000000000 THEN format('{:,}', (budget_amount + 50000000) // 100000000) || '億円'
WHEN budget_amount >= 100000000 THEN CAST((budget_amount + 5000000) // 10000000 // 10 AS VARCHAR) || '.' || CAST((budget_amount + 5000000) // 10000000 % 10 AS VARCHAR) || '億円'
WHEN budget_amount >= 10000 THEN CAST((budget_amount + 5000) // 10000 AS VARCHAR) || '万円' ELSE format('{:,}', budget_amount) || '円' END, ' ', '') AS rounded, format('{:,}', budget_amount) || '円' AS whole FROM project WHERE budget_amount IS NOT NULL""")
def displayed_amounts(t: Harness) -> DataFrame:
    a = F.col("budget_amount")
    return t.project.where(a.isNotNull()).select("project_id", "budget_amount", T.rounded_amount(a).alias("rounded"), T.full_amount(a).alias("whole"))


@query("SELECT upper(event_type) AS source_name, CAST(ts AS DATE) AS as_of, '取得日' AS date_kind, count(*) AS graphs FROM events GROUP BY ALL", prelude=False)
def folded_freshness(t: Harness) -> DataFrame:
    return freshness.folded(t.raw("events").select(F.upper("event_type").alias("source_name"), F.col("ts").alias("as_of"), F.lit("取得日").alias("date_kind")))


@query("""SELECT s.source, max(e.d) AS last_fetched_on, s.cadence, CAST(date_diff('day', max(e.d), DATE '2024-02-10') AS INTEGER) AS days FROM (VALUES ('click', 5), ('view', 400), ('never', 30)) s(source, cadence)
LEFT JOIN (SELECT event_type, CAST(ts AS DATE) AS d FROM events) e ON e.event_type = s.source GROUP BY s.source, s.cadence HAVING max(e.d) IS NULL OR date_diff('day', max(e.d), DATE '2024-02-10') > s.cadence""", prelude=False)
def stale_sources(t: Harness) -> DataFrame:
    """Sources older than their cadence; one that was never fetched is stale, one without a cadence never."""
    sources = _named(t, (("click", 5), ("view", 400), ("never", 30), ("reference", None)), "source string, cadence int")
    fetched = t.raw("events").select(F.col("event_type").alias("source"), F.to_date("ts").alias("date"))
    return freshness.stale(sources, fetched, F.lit("2024-02-10").cast("date"))


@query("""SELECT source, max(struct_pack(d := d, f := f)).d AS date, max(struct_pack(d := d, f := f)).f AS file FROM (SELECT event_type AS source, CAST(ts AS DATE) AS d, 'f' || CAST(user_id % 7 AS VARCHAR) AS f FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-15') GROUP BY source""", prelude=False)
def snapshots_as_of(t: Harness) -> DataFrame:
    rows = t.raw("events").select(F.col("event_type").alias("source"), F.to_date("ts").alias("date"), F.concat(F.lit("f"), (F.col("user_id") % 7).cast("string")).alias("file"))
    return lake.latest_before(rows, F.lit("2024-01-15").cast("date"))


@query("SELECT date_trunc('minute', ts) AS minute, user_id, count(*) AS calls, count(*) - 1 AS refused FROM events GROUP BY ALL HAVING count(*) > 1", prelude=False)
def rate_limited_calls(t: Harness) -> DataFrame:
    return usage.over_limit(t.raw("events"), 1, "user_id")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS used, count(*) >= 330 AS exhausted FROM events GROUP BY 1", prelude=False)
def daily_token_budget(t: Harness) -> DataFrame:
    return usage.tokens_per_day(t.raw("events").withColumn("tokens", F.lit(1)), "tokens", 330)


# Resolution


@query(f"""SELECT law_id, n.name, CASE WHEN names = ['?'] THEN 'EXTRACTION_FAILED' WHEN c.k = 1 THEN 'resolved' WHEN c.k > 1 THEN 'AMBIGUOUS' WHEN n.name = '大蔵省' THEN 'resolved_abolished' WHEN n.name IN ('総理府', '海軍軍令部') THEN 'OLD_MINISTRY'
WHEN regexp_matches(n.name, '(省|府|庁|院|委員会)$') THEN 'OBSOLETE_ORGANIZATION' ELSE 'NO_CANDIDATE' END AS outcome, CASE WHEN c.k = 1 THEN c.corp_no WHEN n.name = '大蔵省' THEN '大蔵省' END AS resolved
FROM (SELECT law_id, names, unnest(names) AS raw FROM (SELECT law_id, CASE p_partkey % 11 WHEN 0 THEN ['大蔵省'] WHEN 1 THEN ['総理府', '大蔵省'] WHEN 3 THEN ['人事院'] WHEN 4 THEN ['財務省'] WHEN 5 THEN ['?'] WHEN 7 THEN ['?'] WHEN 8 THEN ['内閣府'] WHEN 9 THEN ['逓信省'] WHEN 10 THEN ['?'] END AS names FROM law) WHERE names IS NOT NULL) x
CROSS JOIN LATERAL (SELECT CASE WHEN x.raw <> '?' THEN x.raw END AS name) n LEFT JOIN (SELECT name, count(*) AS k, min(corp_no) AS corp_no FROM {_GIVEN} GROUP BY name) c ON n.name = c.name""")
def jurisdiction_ladder(t: Harness) -> DataFrame:
    """Ministries from law numbers of every form; the oracle has the names written out by form."""
    return resolve.jurisdictions(t.law, _named(t, CURRENT, "name string, corp_no string"), _named(t, OLD, "name string"), _named(t, ABOLISHED, "name string"))


@query("""SELECT project_id, CASE WHEN c.k = 1 THEN c.law_id END AS resolved, CASE WHEN x.given IS NOT NULL THEN CASE WHEN l.law_id IS NULL THEN 'NO_CANDIDATE' END WHEN coalesce(c.k, 0) = 1 THEN NULL WHEN c.k > 1 THEN 'AMBIGUOUS' ELSE 'NO_CANDIDATE' END AS reason
FROM (SELECT project_id, CASE WHEN project_id % 3 = 0 THEN 'X' || CAST(project_id AS VARCHAR) END AS given, 'title ' || CAST(project_id % 5000 AS VARCHAR) AS title FROM project) x LEFT JOIN law l ON x.given = l.law_id
LEFT JOIN (SELECT title, count(*) AS k, min(law_id) AS law_id FROM (SELECT law_id, 'title ' || CAST(p_partkey AS VARCHAR) AS title FROM law UNION ALL SELECT law_id, 'title ' || CAST(p_partkey + 3 AS VARCHAR) FROM law WHERE p_partkey % 10 = 0) GROUP BY title) c ON x.title = c.title AND x.given IS NULL""")
def basis_law_ladder(t: Harness) -> DataFrame:
    """Citations by an unknown id (whose title isn't tried), a title with a note, a title that two laws share, and none."""
    k = F.col("project_id")
    title = F.concat(F.lit("title "), (k % 5000).cast("string"), F.when(k % 2 == 0, "（昭和二十年法律第一号） ").otherwise(""))
    citations = t.project.select("project_id", F.when(k % 3 == 0, F.concat(F.lit("X"), k.cast("string"))).alias("law_id"), title.alias("law_title"))
    p = F.col("p_partkey")
    laws = t.law.select("law_id", F.concat(F.lit("title "), p.cast("string")).alias("law_title"), F.when(p % 10 == 0, F.array(F.concat(F.lit("title "), (p + 3).cast("string")))).alias("abbrev"))
    return resolve.basis_laws(citations, laws).select("project_id", "resolved", "reason")


@query("""SELECT project_id, seq, CASE WHEN s % 10 = 0 THEN 'bundled' WHEN s % 10 = 1 THEN 'sentinel_or_nonexistent_houjin_bangou' WHEN s % 10 = 2 THEN 'sentinel_or_nonexistent_houjin_bangou' WHEN s % 10 IN (3, 4, 5) THEN 'resolved' WHEN s % 10 = 6 THEN 'unresolved' ELSE 'resolved' END AS category,
CASE WHEN s % 10 = 6 THEN 'NO_CANDIDATE' END AS reason, CASE WHEN s % 10 IN (3, 4, 5, 7, 8, 9) THEN lpad(CAST(s + 1000 AS VARCHAR), 13, '0') END AS recipient FROM (SELECT project_id, seq, l_suppkey AS s FROM expenditure)""")
def recipient_ladder(t: Harness) -> DataFrame:
    """Bundled, sentinel, unknown number, known number, unknown name and unique name with a kind of corporation, by supplier."""
    s = F.col("l_suppkey")
    name = F.concat(F.lit("Supplier#"), F.lpad(s.cast("string"), 9, "0"))
    number = F.when(s % 10 == 1, "9999999999999").when(s % 10 == 2, F.concat(F.lit("8"), F.lpad(s.cast("string"), 12, "0"))).when(s % 10 <= 5, F.lpad((s + 1000).cast("string"), 13, "0"))
    payee = F.when(s % 10 == 6, "nobody").otherwise(F.concat(F.lit("株式会社"), name))
    lines = t.expenditure.select("project_id", "seq", payee.alias("payee"), number.alias("corp_no"), (s % 10 == 0).alias("is_bundled"))
    names = t.organization.select(F.col("name").alias("name_key"), "corp_no")
    return resolve.recipients(lines, t.organization, names).select("project_id", "seq", "category", "reason", "recipient")


@query("""SELECT p.project_id, CASE WHEN c.k = 1 THEN c.corp_no END AS resolved, CASE WHEN c.k IS NULL THEN 'NO_CANDIDATE' WHEN c.k > 1 THEN 'AMBIGUOUS' END AS reason FROM (SELECT project_id, 'N' || CAST(project_id % 40 AS VARCHAR) AS wanted FROM project) p
LEFT JOIN (SELECT name, count(*) AS k, min(corp_no) AS corp_no FROM (SELECT 'N' || CAST(CAST(corp_no AS INTEGER) AS VARCHAR) AS name, corp_no FROM organ UNION ALL SELECT 'N5', 'M') GROUP BY name) c ON p.wanted = c.name""")
def project_ministry_by_name(t: Harness) -> DataFrame:
    names = t.organ.select(F.concat(F.lit("N"), F.col("corp_no").cast("int").cast("string")).alias("n"), "corp_no").unionByName(_named(t, (("N5", "M"),), "n string, corp_no string"))
    rows = t.project.select("project_id", F.concat(F.lit("N"), (F.col("project_id") % 40).cast("string")).alias("wanted"))
    return resolve.by_unique_name(rows, "wanted", names, "n", "corp_no").select("project_id", "resolved", "reason")


# Records


@query("""SELECT corp_no, name, updated_on FROM (SELECT *, row_number() OVER (PARTITION BY corp_no ORDER BY updated_on DESC, row_idx DESC) AS n FROM
(SELECT lpad(CAST(user_id AS VARCHAR), 13, '0') AS corp_no, event_type AS name, CASE WHEN event_id % 4 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS updated_on, event_id AS row_idx FROM events)) WHERE n = 1""", prelude=False)
def deduplicated_organizations(t: Harness) -> DataFrame:
    e = F.col("event_id")
    rows = t.raw("events").select(F.lpad(F.col("user_id").cast("string"), 13, "0").alias("corp_no"), F.col("event_type").alias("name"), F.when(e % 4 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("updated_on"), e.alias("row_idx"))
    return records.deduplicated_organizations(rows).select("corp_no", "name", "updated_on")


@query("SELECT project_id, min_by(name, row_idx) AS name, min(row_idx) AS row_idx FROM (SELECT user_id AS project_id, event_type AS name, event_id AS row_idx FROM events) GROUP BY project_id", prelude=False)
def first_row_spine(t: Harness) -> DataFrame:
    rows = t.raw("events").select(F.col("user_id").alias("project_id"), F.col("event_type").alias("name"), F.col("event_id").alias("row_idx"))
    return records.first(rows, ["project_id"], ["row_idx"])


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1", prelude=False)
def duplicate_keys(t: Harness) -> DataFrame:
    return records.duplicate_keys(t.raw("events"), ["user_id", "event_type"])


@query("SELECT user_id AS project_id, event_type AS block_id, max_by('role ' || CAST(event_id % 5 AS VARCHAR), event_id) AS role FROM events WHERE event_id % 5 <> 4 AND event_id % 3 = 0 GROUP BY ALL", prelude=False)
def last_block_roles(t: Harness) -> DataFrame:
    """Block rows are those without a payee; the last one that names a role decides."""
    e = F.col("event_id")
    rows = t.raw("events").select(F.col("user_id").alias("project_id"), e.alias("row_idx"), F.when(e % 3 == 0, " ").otherwise("payee").alias("payee"), F.col("event_type").alias("block_id"), F.when(e % 5 == 4, "").otherwise(F.concat(F.lit(" role "), (e % 5).cast("string"), F.lit("　"))).alias("role"))
    return records.last_roles(rows)


@query("""SELECT project_id, block_id, array_to_string(list(src ORDER BY pos), ',') AS funded_by FROM (SELECT user_id AS project_id, event_type AS block_id, 'B' || CAST(event_id % 7 AS VARCHAR) AS src, min(event_id) AS pos FROM events GROUP BY ALL) GROUP BY project_id, block_id""", prelude=False)
def ordered_distinct_sources(t: Harness) -> DataFrame:
    e = F.col("event_id")
    rows = t.raw("events").select(F.col("user_id").alias("project_id"), e.alias("row_idx"), F.concat(F.lit("B"), (e % 7).cast("string"), F.lit(" ")).alias("block_from"), F.lit("").alias("block_from_name"), F.lit("").alias("paid"), F.col("event_type").alias("block_to"), F.lit("n").alias("block_to_name"), F.lit("").alias("note"))
    schema = "project_id bigint, block_id string, block_name string, role string, amount bigint, payee_count bigint"
    made = records.blocks(t.spark.createDataFrame([], schema), rows).where("size(funded_by) > 0")
    return made.select("project_id", "block_id", F.array_join("funded_by", ",").alias("funded_by"))


@query("SELECT CASE event_id % 6 WHEN 0 THEN 'paid' WHEN 1 THEN 'edge' WHEN 2 THEN 'edge' WHEN 3 THEN 'indirect' ELSE 'empty' END AS kind, count(*) AS n FROM events GROUP BY 1", prelude=False)
def connection_row_kinds(t: Harness) -> DataFrame:
    k = F.col("event_id") % 6
    rows = t.raw("events").select(F.when(k == 2, "A").otherwise("").alias("block_from"), F.lit("").alias("block_from_name"), F.when(k == 0, " true ").otherwise("").alias("paid"), F.when(k < 3, "B").otherwise(" ").alias("block_to"), F.lit("").alias("block_to_name"), F.lit("").alias("note"), F.lit("").alias("indirect_flag"), F.when(k == 3, "travel").otherwise("").alias("item"), F.when(k == 3, "10").otherwise("").alias("amount"))
    return records.connection_kinds(rows).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN event_id % 7 = 0 THEN 'block' WHEN event_id % 3 <> 0 THEN 'kept' WHEN event_id % 2 = 0 THEN 'contract_detail' ELSE 'missing_amount' END AS kind, count(*) AS n FROM events GROUP BY 1", prelude=False)
def payee_row_kinds(t: Harness) -> DataFrame:
    e = F.col("event_id")
    rows = t.raw("events").select(F.when(e % 7 == 0, "　").otherwise("payee").alias("payee"), F.when(e % 3 != 0, "1,000").otherwise(" ").alias("amount"), F.when(e % 2 == 0, "5").otherwise("").alias("contract_amount"))
    return records.payee_kinds(rows).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT project_id, budget_year, initial FROM annual WHERE project_id % 10 <> 0")
def aggregate_budget_rows(t: Harness) -> DataFrame:
    """A key and year has one row with an initial amount beside detail rows, or none."""
    rows = t.annual.select("project_id", F.col("budget_year").alias("budget_fiscal_year"), F.when(F.col("project_id") % 10 != 0, F.col("initial").cast("string")).otherwise(" ").alias("initial"))
    rows = rows.unionByName(rows.withColumn("initial", F.lit("")))
    return records.aggregate_budget_rows(rows, ["project_id"]).select("project_id", F.col("budget_fiscal_year").alias("budget_year"), T.amount(F.col("initial")).alias("initial"))


# Scalar functions


@query("SELECT l_partkey, l_linenumber, CAST(round(l_extendedprice) AS BIGINT) * CASE WHEN l_linenumber = 3 THEN -1 ELSE 1 END AS amount FROM lineitem", prelude=False)
def normalized_amounts(t: Harness) -> DataFrame:
    """Amounts in the spellings of the sources, read back: separators, full width, a trailing .0, spaces."""
    n = F.round("l_extendedprice").cast("bigint")
    line = F.col("l_linenumber")
    grouped = F.regexp_replace(n.cast("string"), r"(\d)(?=(\d{3})+$)", "$1,")
    wide = F.translate(n.cast("string"), "0123456789", "０１２３４５６７８９")
    raw = F.when(line == 1, F.concat(F.lit(" "), grouped, F.lit("　"))).when(line == 2, wide).when(line == 3, F.concat(F.lit("-"), n.cast("string"))).otherwise(F.concat(n.cast("string"), F.lit(".0")))
    return t.raw("lineitem").select("l_partkey", "l_linenumber", T.amount(raw).alias("amount"))


@query("SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS digest FROM documents", prelude=False)
def digested_texts(t: Harness) -> DataFrame:
    return t.raw("documents").select("doc_id", T.content_digest(F.col("text")).alias("digest"))


@query("SELECT doc_id, sha256(url_encode(text)) AS quoted_sha256 FROM documents", prelude=False)
def quoted_whole_texts(t: Harness) -> DataFrame:
    return t.raw("documents").select("doc_id", F.sha2(iri.quote(F.col("text")), 256).alias("quoted_sha256"))


@query("SELECT page_id, CASE WHEN contains(url, '#') THEN regexp_extract(url, '([^#]*)$', 1) ELSE regexp_extract(url, '([^/]*)$', 1) END AS local_name FROM pages", prelude=False)
def local_names(t: Harness) -> DataFrame:
    return t.raw("pages").select("page_id", iri.local_name(F.col("url")).alias("local_name"))


@query("SELECT s_suppkey, s_name AS bare, s_name AS key FROM supplier", prelude=False)
def stripped_names(t: Harness) -> DataFrame:
    name = F.col("s_name")
    noted = F.concat(name, F.when(F.col("s_suppkey") % 2 == 0, "（注）　").otherwise("(note) "))
    key = F.concat(F.lit("株式会社　"), name, F.lit(" (有)"))
    return t.raw("supplier").select("s_suppkey", T.without_note(noted).alias("bare"), T.without_corporate_words(key).alias("key"))


@query("SELECT c_custkey, c_name AS name FROM customer", prelude=False)
def composed_names(t: Harness) -> DataFrame:
    """Compatibility forms come back as the plain characters they stand for."""
    wide = F.translate(F.col("c_name"), "#0123456789", "＃０１２３４５６７８９")
    return t.raw("customer").select("c_custkey", T.corporate_name(F.concat(F.lit("㈱"), wide)).alias("name"))


@query("SELECT doc_id, contains(lower(text), 'the ') AS has_word, coalesce(toxic = 1, false) AS flagged FROM documents LEFT JOIN labels USING (doc_id)", prelude=False)
def case_insensitive_contains(t: Harness) -> DataFrame:
    labels = t.raw("labels").select("doc_id", T.truth(F.col("toxic").cast("string")).alias("flagged"))
    rows = t.raw("documents").select("doc_id", F.lower("text").contains("the ").alias("has_word")).join(labels, "doc_id", "left")
    return rows.select("doc_id", "has_word", F.coalesce("flagged", F.lit(False)).alias("flagged"))


@query("SELECT right(p_name, 1) AS ending, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, ending LIMIT 20", prelude=False)
def ending_histogram(t: Harness) -> DataFrame:
    return t.raw("part").groupBy(F.expr("right(p_name, 1)").alias("ending")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ending").limit(20)
