"""Queries of traversal, search graphs, ontologies, releases and the gate over the driver's tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import iri
from ..operators import digest_tree, graph, lineage, ontology, records, recursive, release, resolve, validate
from ..operators import quads as Q
from ..sources import api_snapshot, nquads_sink
from ..streaming import ingest
from .catalog import query
from .derived import CENTER
from .harness import PRELUDE, Harness

RECURSIVE = PRELUDE.replace("WITH organ", "WITH RECURSIVE organ", 1)


def _folder(t: Harness, name: str) -> str:
    """A new folder that all executors share, removed when the driver ends."""
    folder = f"{lineage.shared(t.spark)}/{name}-{uuid4().hex}"
    lineage.remove_at_exit(t.spark, folder)
    return folder


def _types(t: Harness) -> DataFrame:
    """(node, type) of all nodes of edge."""
    kinds = t.organ.select(F.col("corp_no").alias("node"), F.lit("Organization").alias("type")).unionByName(t.law.select(F.col("law_id").alias("node"), F.lit("Law").alias("type")))
    return kinds.unionByName(t.project.select(F.concat(F.lit("P"), F.col("project_id").cast("string")).alias("node"), F.lit("Expenditure").alias("type")))


# Traversal


@query(RECURSIVE + f""", link AS (SELECT src, dst FROM edge WHERE predicate = 'jurisdiction' UNION SELECT dst, src FROM edge WHERE predicate = 'jurisdiction'),
walk AS (SELECT '{CENTER}' AS node, 0 AS depth, ['{CENTER}'] AS visited UNION ALL SELECT l.dst, depth + 1, list_append(visited, l.dst) FROM walk w JOIN link l ON w.node = l.src WHERE depth < 4 AND NOT list_contains(visited, l.dst))
SELECT node, min(depth) AS hops, split_part(min(lpad(CAST(depth AS VARCHAR), 2, '0') || ':' || array_to_string(visited, ' ')), ':', 2) AS path FROM walk WHERE node IN (SELECT corp_no FROM organ) GROUP BY node""", prelude=False)
def organ_paths(t: Harness) -> DataFrame:
    """Shortest paths over laws from one organ to all that are within four steps, as recursive SQL."""
    own = t.edge.where("predicate = 'jurisdiction'").select("src", "dst")
    links = own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    organs = t.organ.select(F.col("corp_no").alias("node"))
    found = recursive.shortest_paths(links, organs.where(F.col("node") == CENTER), organs, 4)
    return found.select("node", "hops", F.array_join("path", " ").alias("path"))


_PATH_TO = "L11"


@query(f"""SELECT min(d) IS NOT NULL AS found, min(d) AS hops, '{CENTER}' AS start, '{_PATH_TO}' AS goal FROM (
  SELECT CAST(1 AS BIGINT) AS d FROM jurisdiction WHERE organ = '{CENTER}' AND law_id = '{_PATH_TO}'
  UNION ALL SELECT 3 FROM jurisdiction a JOIN jurisdiction b ON a.law_id = b.law_id JOIN jurisdiction c ON c.organ = b.organ WHERE a.organ = '{CENTER}' AND c.law_id = '{_PATH_TO}'
  UNION ALL SELECT 5 FROM jurisdiction a JOIN jurisdiction b ON a.law_id = b.law_id JOIN jurisdiction c ON c.organ = b.organ JOIN jurisdiction d ON d.law_id = c.law_id JOIN jurisdiction e ON e.organ = d.organ WHERE a.organ = '{CENTER}' AND e.law_id = '{_PATH_TO}')""")
def path_between(t: Harness) -> DataFrame:
    """Whether and over how many hops the search from both ends joins an organ and a law."""
    own = t.edge.where("predicate = 'jurisdiction'")
    found = graph.find_path(own, CENTER, _PATH_TO, max_depth=6, visit_budget=2000, fanout=200)
    return t.spark.createDataFrame([(found.found, len(found.edges) if found.found else None, CENTER, _PATH_TO)], "found boolean, hops bigint, start string, goal string")


@query(RECURSIVE + """, link AS (SELECT project_id, source_id AS src, block_id AS dst FROM funding UNION SELECT project_id, max(block_id), min(block_id) FROM block WHERE project_id % 3 = 0 GROUP BY project_id HAVING max(block_id) <> min(block_id)),
start AS (SELECT b.project_id, b.block_id AS node FROM block b WHERE project_id % 3 = 0 OR NOT EXISTS (SELECT 1 FROM link l WHERE l.project_id = b.project_id AND l.dst = b.block_id)),
walk AS (SELECT project_id, node, 0 AS depth, [node] AS visited FROM start UNION ALL SELECT w.project_id, l.dst, depth + 1, list_append(visited, l.dst) FROM walk w JOIN link l ON w.project_id = l.project_id AND w.node = l.src WHERE depth < 6 AND NOT list_contains(visited, l.dst))
SELECT project_id, node, max(depth) AS level FROM walk GROUP BY project_id, node""", prelude=False)
def flow_levels_with_cycles(t: Harness) -> DataFrame:
    """Levels of blocks where every third project pays back from its last block to its first, as recursive SQL."""
    links = t.kept_funding.select("project_id", F.col("source_id").alias("src"), F.col("block_id").alias("dst"))
    back = t.kept_block.where("project_id % 3 = 0").groupBy("project_id").agg(F.max("block_id").alias("src"), F.min("block_id").alias("dst")).where("src <> dst")
    return recursive.longest_levels(links.unionByName(back), t.kept_block.select("project_id", F.col("block_id").alias("node")), ("project_id",), 6)


_FIRST = "(SELECT node, src, dst, predicate, row_number() OVER (PARTITION BY node ORDER BY direction, predicate, other) AS n FROM (SELECT src AS node, 'outgoing' AS direction, predicate, dst AS other, src, dst FROM edge UNION ALL SELECT dst, 'incoming', predicate, src, src, dst FROM edge))"


@query(f"""SELECT DISTINCT src, dst, predicate FROM {_FIRST} WHERE n <= 5 AND (node = '{CENTER}' OR node IN (SELECT CASE WHEN src = '{CENTER}' THEN dst ELSE src END FROM {_FIRST} WHERE n <= 5 AND node = '{CENTER}'))""")
def neighborhood_of_depth_two(t: Harness) -> DataFrame:
    """The first five hops of a ministry, and of each node that they lead to."""
    found = graph.neighborhood(t.edge, CENTER, 2, 500, 1000, 5)
    return t.spark.createDataFrame([e[:3] for e in found.edges], "src string, dst string, predicate string")


@query("""SELECT id, CASE type WHEN 'Organization' THEN CASE WHEN id IN (SELECT dst FROM edge WHERE predicate = 'ministry') THEN 'recipient' ELSE 'other' END WHEN 'Law' THEN 'law' ELSE 'expenditure' END AS lane
FROM (SELECT corp_no AS id, 'Organization' AS type FROM organ UNION ALL SELECT law_id, 'Law' FROM law UNION ALL SELECT 'P' || CAST(project_id AS VARCHAR), 'Expenditure' FROM project)""")
def lanes_of_nodes(t: Harness) -> DataFrame:
    """Organs that projects belong to stand for recipients here."""
    edges = t.edge.withColumn("predicate", F.when(F.col("predicate") == "ministry", "recipient").otherwise(F.col("predicate")))
    return graph.lanes(_types(t).withColumnRenamed("node", "id"), edges).select("id", "lane")


@query(f"""SELECT id, type FROM (SELECT corp_no AS id, 'Organization' AS type FROM organ UNION ALL SELECT law_id, 'Law' FROM law)
WHERE id = '{CENTER}' OR id IN (SELECT src FROM edge WHERE predicate = 'jurisdiction' UNION ALL SELECT dst FROM edge WHERE predicate = 'jurisdiction')""")
def filtered_graph_nodes(t: Harness) -> DataFrame:
    """Of organs and laws those that a jurisdiction joins, and the center."""
    nodes, _ = graph.filtered(_types(t).withColumnRenamed("node", "id"), t.edge, CENTER, ["Organization", "Law"], ["jurisdiction", "ministry"])
    return nodes


@query("""SELECT src, dst, predicate, CASE WHEN predicate = 'jurisdiction' THEN 'second' ELSE 'first' END AS seen FROM edge""")
def merged_graph_edges(t: Harness) -> DataFrame:
    """Of an edge that two graphs have the last one's row stays."""
    one, two = t.edge.withColumn("seen", F.lit("first")), t.edge.where("predicate = 'jurisdiction'").withColumn("seen", F.lit("second"))
    none = t.organ.select(F.col("corp_no").alias("id")).withColumn("label", F.lit("")).limit(0)
    return graph.merged([none, none], [one, two])[1].select("src", "dst", "predicate", "seen")


_SEARCH = RECURSIVE + """, hit AS (SELECT law_id AS node FROM law WHERE p_partkey % 40 = 7 UNION SELECT law_id FROM law WHERE p_partkey % 60 = 0),
near AS (SELECT src, dst, predicate FROM edge WHERE src IN (SELECT node FROM hit) OR dst IN (SELECT node FROM hit)),
beside AS (SELECT node, count(DISTINCT other) AS hits FROM (SELECT src AS node, dst AS other FROM near UNION ALL SELECT dst, src FROM near) WHERE other IN (SELECT node FROM hit) AND node NOT IN (SELECT node FROM hit) GROUP BY node),
kept AS (SELECT node, CASE WHEN node LIKE 'P%' THEN 'bridge' ELSE 'connecting' END AS role FROM beside WHERE node NOT LIKE 'P%' OR hits >= 2),
stays AS (SELECT node FROM hit UNION SELECT node FROM kept), links AS (SELECT * FROM near WHERE src IN (SELECT node FROM stays) AND dst IN (SELECT node FROM stays)),
"""


@query(_SEARCH + """named AS (SELECT node, CASE WHEN node IN (SELECT src FROM links UNION ALL SELECT dst FROM links) THEN 'connected_hit' ELSE 'isolated_hit' END AS role FROM hit UNION ALL SELECT node, role FROM kept),
reach AS (SELECT node, node AS other FROM stays UNION SELECT r.node, l.dst FROM reach r JOIN (SELECT src, dst FROM links UNION SELECT dst, src FROM links) l ON r.other = l.src)
SELECT node, role, (SELECT min(other) FROM reach r WHERE r.node = named.node) AS component FROM named""", prelude=False)
def search_graph_nodes(t: Harness) -> DataFrame:
    """Hits that are connected or isolated, organs that connect them, and projects next to two or more."""
    nodes, _ = graph.search_graph(t.edge, _types(t), _hits(t))
    return nodes.select("node", "role", "component")


@query(_SEARCH + "last AS (SELECT 1) SELECT src, dst, predicate FROM links", prelude=False)
def search_graph_links(t: Harness) -> DataFrame:
    return graph.search_graph(t.edge, _types(t), _hits(t))[1].select("src", "dst", "predicate")


def _hits(t: Harness) -> DataFrame:
    return t.law.where("p_partkey % 40 = 7 or p_partkey % 60 = 0").select(F.col("law_id").alias("node"))


# Ontology: classes from types of parts, their brands and sizes, an enum from brands


def _ontology(t: Harness) -> DataFrame:
    """Sizes of a brand of a type are below the brand of the type, this below the type, and this below Entity; brands of ECONOMY are directly below Entity too. Some classes are below one of their own subclasses."""
    brand = F.translate("p_brand", "#", "")
    parts = t.raw("part").select("p_type", brand.alias("brand"), F.col("p_size").cast("string").alias("size")).distinct()
    names = [F.lit("Entity"), F.col("p_type"), F.concat_ws("_", "p_type", "brand"), F.concat_ws("_", "p_type", "brand", "size")]
    levels = parts.select("p_type", "size", F.posexplode(F.array(*[F.struct(a.alias("sub"), b.alias("super")) for a, b in zip(names[1:], names)])).alias("level", "x")).select("p_type", "size", "level", "x.*")
    more = levels.where("p_type = 'ECONOMY' and level = 1").select("sub", F.lit("Entity").alias("super"))
    back = levels.where("size = '7' and level = 2").select(F.col("super").alias("sub"), F.col("sub").alias("super"))
    levels = levels.select("sub", "super").distinct()
    below = levels.unionByName(more).unionByName(back).distinct()
    at = lambda c: F.concat(F.lit("http://example.org/o#"), c)
    quad = lambda rows, s, p, o, kind: rows.select(at(s).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    classes, values = levels.select("sub").distinct(), parts.select("brand").distinct()
    value = F.concat(F.lit("BrandEnum/"), F.col("brand"))
    made = quad(classes, F.col("sub"), Q.TYPE, F.lit(f"{ontology.OWL}Class"), Q.URI).unionByName(quad(classes, F.col("sub"), ontology.TITLE, F.lower("sub"), Q.LITERAL)).unionByName(quad(below, F.col("sub"), ontology.SUBCLASS, at(F.col("super")), Q.URI))
    made = made.unionByName(quad(classes, F.col("sub"), ontology.SUBCLASS, F.lit("restriction"), "bnode"))
    made = made.unionByName(quad(values, value, Q.TYPE, F.lit(f"{ontology.OWL}Class"), Q.URI)).unionByName(quad(values, value, ontology.TITLE, F.lower("brand"), Q.LITERAL)).unionByName(quad(values, value, ontology.SUBCLASS, at(F.lit("BrandEnum")), Q.URI))
    one = t.raw("region").where("r_regionkey = 0")
    predicate = F.lit("brand")
    return made.unionByName(quad(one, predicate, Q.TYPE, F.lit(f"{ontology.OWL}ObjectProperty"), Q.URI)).unionByName(quad(one, predicate, ontology.TITLE, F.lit("the brand"), Q.LITERAL)).unionByName(quad(one, predicate, ontology.RANGE, at(F.lit("BrandEnum")), Q.URI))


_CLASSES = "SELECT DISTINCT p_type, replace(p_brand, '#', '') AS brand, n, array_to_string([p_type, replace(p_brand, '#', ''), CAST(p_size AS VARCHAR)][1:n], '_') AS name FROM part, range(1, 4) r(n)"


@query(f"SELECT DISTINCT name, CASE WHEN p_type = 'ECONOMY' AND n > 1 THEN 'ECONOMY_' || brand ELSE p_type END AS axis FROM ({_CLASSES})", prelude=False)
def ontology_axes(t: Harness) -> DataFrame:
    return ontology.axes(_ontology(t))


@query(f"SELECT DISTINCT 'type' AS kind, name, lower(name) AS label FROM ({_CLASSES}) UNION ALL SELECT 'predicate', 'brand', 'the brand'", prelude=False)
def ontology_labels(t: Harness) -> DataFrame:
    return ontology.labels(_ontology(t))


@query("SELECT DISTINCT 'brand' AS predicate, replace(p_brand, '#', '') AS value, lower(replace(p_brand, '#', '')) AS label FROM part", prelude=False)
def ontology_enum_values(t: Harness) -> DataFrame:
    return ontology.enum_values(_ontology(t))


# Names made of names


@query("""SELECT n.n_name AS target, CAST(n.n_nationkey AS BIGINT) AS row_index, CASE n.n_nationkey % 3 WHEN 0 THEN 'exact' ELSE 'prefix-decomposition(' || p.n_name || ')' END AS mechanism
FROM nation n JOIN nation p ON p.n_nationkey = (n.n_nationkey + 1) % 25 WHERE n.n_nationkey % 3 <> 2""", prelude=False)
def old_names_decomposed(t: Harness) -> DataFrame:
    """Every third nation is named as it is, the next with another one before it, the third with a word that is none."""
    n = t.raw("nation")
    before = n.select(((F.col("n_nationkey") + 24) % 25).alias("n_nationkey"), F.col("n_name").alias("head"))
    named = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat("head", "n_name")).otherwise(F.concat(F.lit("no "), "n_name"))
    rows = n.join(before, "n_nationkey").select(F.col("n_nationkey").cast("bigint").alias("row_index"), named.alias("old_name"))
    return resolve.old_ministries(rows, n.select(F.col("n_name").alias("name"))).select("target", "row_index", "mechanism")


@query("""WITH n AS (SELECT n_nationkey AS k, n_name || '.' AS name FROM nation), c AS (SELECT DISTINCT c_custkey % 4 AS k, a.name AS a, b.name AS b, d.name AS d FROM customer JOIN n a ON a.k = c_nationkey JOIN n b ON b.k = (c_nationkey + 7) % 25 JOIN n d ON d.k = (c_nationkey + 11) % 25)
SELECT CASE k WHEN 0 THEN a WHEN 1 THEN b || a ELSE d || b || a END AS name, a AS successor, CASE k WHEN 0 THEN 'exact' WHEN 1 THEN 'suffix-decomposition(' || b || ')' ELSE 'suffix-decomposition(' || d || '+' || b || ')' END AS mechanism FROM c WHERE k <> 3""", prelude=False)
def successors_by_suffix(t: Harness) -> DataFrame:
    """Names of one to three nations in a row, each ended by a stop; others end in a word that is none."""
    name = F.concat("n_name", F.lit("."))
    n = lambda c, k: t.raw("nation").select(name.alias(c), ((F.col("n_nationkey") + k) % 25).alias("c_nationkey"))
    rows = t.raw("customer").select("c_nationkey", (F.col("c_custkey") % 4).alias("k")).distinct().join(n("a", 0), "c_nationkey").join(n("b", 18), "c_nationkey").join(n("d", 14), "c_nationkey")
    made = F.when(F.col("k") == 0, F.col("a")).when(F.col("k") == 1, F.concat("b", "a")).when(F.col("k") == 2, F.concat("d", "b", "a")).otherwise(F.concat("d", "a", F.lit("?")))
    return resolve.successors(rows.select(made.alias("name")), t.raw("nation").select(name.alias("name")))


# Checks, quarantine and the gate


def _events(t: Harness) -> DataFrame:
    """Quads of events in a graph for each day of the month; types of events are their classes, and purchases are laws without a number every fifth time."""
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "Law").otherwise(F.initcap("event_type"))
    s, g = F.concat(F.lit(f"{iri.BASE}/id/event/"), e.cast("string")), F.concat(F.lit("day-"), F.dayofmonth("ts").cast("string"))
    rows = t.raw("events")
    typed = rows.select(s.alias("s"), F.lit(Q.TYPE).alias("p"), F.concat(F.lit(iri.term("core", "")), kind).alias("o"), F.lit(Q.URI).alias("o_kind"), F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("o_dt"), g.alias("g"))
    return typed.unionByName(Q.emit(rows.where((F.col("event_type") == "purchase") & (e % 97 != 0)), s, [], g, {"lawNum": e.cast("string")}))


@query("SELECT DISTINCT upper(event_type[1]) || event_type[2:] AS class FROM events WHERE event_type <> 'purchase'", prelude=False)
def uncovered_classes(t: Harness) -> DataFrame:
    return validate.uncovered_classes(_events(t))


@query("""SELECT 'day-' || CAST(day(ts) AS VARCHAR) AS g, count(*) + count(*) FILTER (event_type = 'purchase' AND event_id % 97 <> 0) AS quads, count(*) FILTER (event_type = 'purchase' AND event_id % 97 = 0) AS violations
FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase' AND event_id % 97 = 0) > 0""", prelude=False)
def quarantined_graphs(t: Harness) -> DataFrame:
    """Days with a wrong event are set apart whole, with what is wrong, and read back."""
    quads = _events(t)
    folder = _folder(t, "quarantine")
    validate.quarantined(quads, validate.violations(quads), folder)
    count = lambda name, c: t.spark.read.parquet(f"{folder}/{name}").groupBy("g").agg(F.count("*").alias(c))
    return count("quads", "quads").join(count("violations", "violations"), "g")


@query("""SELECT 'annual_identities' AS name, count(*) FILTER (initial + supplementary + carried_in + reserve <> available) AS faults, count(*) AS checked FROM annual WHERE reserve IS NOT NULL
UNION ALL SELECT 'block_sums', count(*) FILTER (b.amount <> e.total), count(*) FROM block b JOIN (SELECT project_id, block_id, sum(amount) AS total FROM expenditure GROUP BY ALL) e USING (project_id, block_id)
UNION ALL SELECT 'duplicate_keys', count(*), count(*) FROM (SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) > 1)""")
def gate_faults(t: Harness) -> DataFrame:
    """What the gate refuses a release for, with how many rows each check looked at."""
    gate = validate.Gate()
    gate.add("annual_identities", validate.annual_identities(t.annual), F.col("wrong"))
    gate.add("block_sums", validate.block_sums(t.block, t.expenditure), F.col("wrong"))
    gate.add("duplicate_keys", records.duplicate_keys(t.raw("events"), ["user_id", "event_type"]))
    try:
        gate.close()
    except validate.ReleaseRefused:
        pass
    return t.spark.createDataFrame([(n, gate.faults[n], gate.checked[n]) for n in gate.faults], "name string, faults bigint, checked bigint")


# Releases


def _lines(t: Harness, changed: bool = False) -> DataFrame:
    """(g, value) of edges; the later release lacks some of basisLaw, has others, and has no ministry."""
    made = t.edge.select("g", F.concat("src", F.lit(" "), "dst").alias("value"))
    if not changed:
        return made
    kept = made.where("g <> 'ministry' and not (g = 'basisLaw' and value like '%7 L1')")
    return kept.unionByName(made.where("g = 'basisLaw' and value like '%9 L2'").withColumn("value", F.concat("value", F.lit(" again"))))


@query("""SELECT g, value, change FROM (SELECT predicate AS g, src || ' ' || dst AS value, 'removed' AS change FROM edge WHERE predicate = 'ministry' OR predicate = 'basisLaw' AND src || ' ' || dst LIKE '%7 L1'
UNION ALL SELECT 'basisLaw', src || ' ' || dst || ' again', 'added' FROM edge WHERE predicate = 'basisLaw' AND src || ' ' || dst LIKE '%9 L2')""")
def changed_lines(t: Harness) -> DataFrame:
    """Lines that differ between two releases, found from the roots of their digest trees down."""
    old, new = _folder(t, "release"), _folder(t, "release")
    digest_tree.save(_lines(t), old)
    digest_tree.save(_lines(t, True), new)
    return digest_tree.changed_lines(t.spark, old, new)


@query("SELECT predicate AS g, count(*) AS n, true AS intact FROM (SELECT DISTINCT src, dst, predicate FROM edge) GROUP BY predicate")
def nquads_files_with_manifest(t: Harness) -> DataFrame:
    """Edges written as files of N-Quads; counts are the manifest's, checked against the files."""
    t.spark.dataSource.register(nquads_sink.NQuadsSink)
    folder = _folder(t, "nquads")
    quads = t.edge.select(F.col("src").alias("s"), F.col("predicate").alias("p"), F.col("dst").alias("o"), F.lit(Q.URI).alias("o_kind"), F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("o_dt"), "g").distinct()
    quads.select("g", Q.line().alias("value")).write.format("nquads").option("path", folder).mode("append").save()
    wrong = nquads_sink.differing(t.spark, folder)
    return t.spark.createDataFrame([(g, x["n"], g not in wrong) for g, x in nquads_sink.manifest(folder)["graphs"].items()], "g string, n bigint, intact boolean")


@query("SELECT predicate AS g, count(*) AS n, CASE WHEN predicate = 'jurisdiction' THEN '2' ELSE '1' END AS delivery FROM (SELECT DISTINCT src, dst, predicate FROM edge WHERE predicate <> 'jurisdiction' OR src LIKE '%1') GROUP BY predicate")
def streamed_graph_versions(t: Harness) -> DataFrame:
    """Edges delivered in many files, one graph again with fewer, and read back from the versions that a stream made of them, two files at once."""
    quads = t.edge.select(F.col("src").alias("s"), F.col("predicate").alias("p"), F.col("dst").alias("o"), F.lit(Q.URI).alias("o_kind"), F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("o_dt"), "g").distinct()
    source, out, state = (_folder(t, x) for x in ("deliveries", "graphs", "state"))
    ingest.deliver(quads.repartition(4), source, "1")
    ingest.deliver(quads.where("g = 'jurisdiction' and s like '%1'"), source, "2")
    ingest.write_graphs(ingest.read_quads(t.spark, source, 2), out, state).awaitTermination()
    return ingest.read_graphs(t.spark, out).groupBy("g").agg(F.count("*").alias("n")).join(ingest.versions(t.spark, out), "g")


# An API's snapshot


@query("""SELECT project_id, 2024 AS fiscal_year, name, amount AS budget_amount, budget_fiscal_year, initial, CASE WHEN budget_fiscal_year = 2023 THEN executed END AS executed FROM (
SELECT CAST(o_orderkey AS VARCHAR) AS project_id, 'project ' || CAST(o_orderkey AS VARCHAR) AS name, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS executed,
  unnest(list_concat(CASE WHEN o_orderkey % 3 <> 0 THEN [struct_pack(budget_fiscal_year := 2024, initial := CAST(round(o_totalprice * 100) AS BIGINT))] ELSE [] END, CASE WHEN o_orderkey % 4 <> 0 THEN [struct_pack(budget_fiscal_year := 2023, initial := o_custkey * 10)]
    WHEN o_orderkey % 5 <> 0 THEN [struct_pack(budget_fiscal_year := 2023, initial := NULL::BIGINT)] ELSE [] END), recursive := true) FROM orders)""", prelude=False)
def api_snapshot_records(t: Harness) -> DataFrame:
    """Orders as pages of JSON with a manifest of their bytes and numbers, checked, and read as projects with annual budgets; histories lack a year, or the list has what they lack."""
    k, amount = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    year = lambda n, value: F.struct(F.lit(n).alias("fiscal_year"), value.alias("initial_budgets_total_amount"))
    history = F.array_compact(F.array(F.when(k % 3 != 0, year(2024, amount)), F.when(k % 4 != 0, year(2023, F.col("o_custkey") * 10))))
    row = F.struct(k.cast("string").alias("id"), F.lpad(k.cast("string"), 12, "0").alias("project_number"), F.concat(F.lit("project "), k.cast("string")).alias("name"), F.lit(2024).alias("fiscal_year"), F.lit(True).alias("is_published"), amount.alias("finalized_amount_for_initial_budget"), F.when(k % 5 != 0, F.col("o_custkey")).alias("previous_year_execution_amount"), history.alias("budget_data"))
    pages = t.raw("orders").groupBy(F.concat(F.lit("page-"), F.floor(k / 1000).cast("string")).alias("file")).agg(F.count("*").alias("rows"), F.encode(F.to_json(F.struct(F.collect_list(row).alias("results"))), "utf-8").alias("content"))
    pages = lineage.cut(pages)
    rows = api_snapshot.checked(pages.select("file", "content"), pages.select("file", F.sha2("content", 256).alias("sha256"), "rows"), pages.agg(F.sum("rows")).first()[0], 2024)
    projects, annual = api_snapshot.records(rows, 2024)
    return projects.join(annual, ["project_id", "fiscal_year"])
