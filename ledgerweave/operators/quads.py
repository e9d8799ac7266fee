"""Typed tables as quads, edges and lines of N-Quads, and what is read back from them.

The default graph is the set union of all named graphs: a pattern without a graph looks at triples(quads), which drops the
graph and repeated triples before any join; a pattern with a graph variable looks at quads.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iri
from ..schema import SEARCHABLE, SPECIFICITY

TYPE, LABEL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2004/02/skos/core#prefLabel"
LITERAL, URI = "literal", "uri"
TERM = ("o", "o_kind", "o_lang", "o_dt")
INTEGER = "http://www.w3.org/2001/XMLSchema#integer"


def _quad(p: str, o: Column, kind: str = LITERAL, lang: str | None = None, dt: str | None = None) -> Column:
    return F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(lang).cast("string").alias("o_lang"), F.lit(dt).cast("string").alias("o_dt"))


def _link(predicate: str) -> Callable[[Column], Column]:
    return lambda o: _quad(iri.term("core", predicate), o, URI)


def emit(rows: DataFrame, subject: Column, kinds: list[str], graph: Column, values: dict[str, Column] | None = None, links: dict[str, Column] | None = None, label: Column | None = None) -> DataFrame:
    """Quads of typed rows: one explode of an array of candidates per row, nulls left out. Links may be arrays of addresses."""
    array = lambda c: c if dict(rows.select(c.alias("x")).dtypes)["x"].startswith("array") else F.array(c)
    made = [F.array(*[_quad(TYPE, F.lit(iri.term("core", k)), URI) for k in kinds])]
    made += [F.array(_quad(LABEL, label, lang="ja"))] if label is not None else []
    numeric = lambda c: dict(rows.select(c.alias("x")).dtypes)["x"] in ("bigint", "int")
    made += [F.array(_quad(iri.term("core", p), c, dt=INTEGER if numeric(c) else None)) for p, c in (values or {}).items()]
    made += [F.transform(array(c), _link(p)) for p, c in (links or {}).items()]
    found = rows.select(subject.alias("s"), graph.alias("g"), F.explode(F.concat(*[F.coalesce(m, F.array().cast(rows.select(m.alias("x")).dtypes[0][1])) for m in made])).alias("q"))
    return found.where("q.o is not null").select("s", "q.*", "g")


def triples(quads: DataFrame) -> DataFrame:
    return quads.select("s", "p", *TERM).distinct()


def edges(quads: DataFrame) -> DataFrame:
    """(src, dst, predicate, g): links between entities. Types and labels are none."""
    own = quads.where((F.col("o_kind") != LITERAL) & ~F.col("p").isin(TYPE, LABEL) & F.col("o").startswith(f"{iri.BASE}/id/") & F.col("s").startswith(f"{iri.BASE}/id/"))
    return own.select(F.col("s").alias("src"), F.col("o").alias("dst"), iri.local_name(F.col("p")).alias("predicate"), "g").distinct()


def type_counts(quads: DataFrame) -> DataFrame:
    """(type, instances): an entity that several graphs give a type counts once."""
    return quads.where(F.col("p") == TYPE).select("s", iri.local_name(F.col("o")).alias("type")).distinct().groupBy("type").agg(F.count("*").alias("instances"))


def specific_types(quads: DataFrame) -> DataFrame:
    """(s, type): the type to show of each entity; unlisted types come after the listed ones, in the order of their names."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in SPECIFICITY]), F.col("type")), F.lit(0)), F.lit(len(SPECIFICITY) + 1))
    own = quads.where(F.col("p") == TYPE).select("s", iri.local_name(F.col("o")).alias("type"))
    return own.groupBy("s").agg(F.min_by("type", F.struct(place, F.col("type"))).alias("type"))


#: Predicates (local names) that tell instances of classes without labels apart.
DESCRIBED_BY = {"AnnualBudget": "budgetFiscalYear", "UnresolvedReference": "text"}


def labels(quads: DataFrame) -> DataFrame:
    """(s, label, described): the least label of each entity, or else the value of its class's describing predicate."""
    own = quads.where(F.col("p") == LABEL).groupBy("s").agg(F.min("o").alias("label"))
    local = iri.local_name(F.col("p"))
    value = quads.where(local.isin(*DESCRIBED_BY.values())).select("s", local.alias("predicate"), F.col("o").alias("value"))
    wanted = F.coalesce(*[F.when(F.col("type") == c, p) for c, p in DESCRIBED_BY.items()])
    described = specific_types(quads).withColumn("predicate", wanted).join(value, ["s", "predicate"], "left").groupBy("s").agg(F.min("value").alias("described"))
    return described.join(own, "s", "left").select("s", F.coalesce("label", "described").alias("label"), F.col("label").isNull().alias("described"))


def search(entities: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Entities(id, type, label, ...) whose label contains query in any case, once each, by label and id. An empty query finds all.

    Rows of an entity are put together before the limit, so that entities with many rows don't crowd out others.
    """
    return found(entities, query, limit).limit(limit)


def found(entities: DataFrame, query: str, limit: int) -> DataFrame:
    """search's hits in order, one more than limit, so that a caller can tell whether there are more.

    Of an entity's rows the label is the least, and every other column the first that isn't null in the order of row_idx, if there is such a column, or else of the labels.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    hits = entities.where(F.col("type").isin(*SEARCHABLE) & F.lower("label").contains(query.lower()))
    rest = [c for c in entities.columns if c not in ("id", "label")]
    place = F.struct("row_idx" if "row_idx" in rest else "label", *[c for c in rest if c != "row_idx"])
    once = hits.groupBy("id").agg(F.min("label").alias("label"), *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in rest])
    return once.orderBy("label", "id").limit(limit + 1)


def attributes(quads: DataFrame) -> DataFrame:
    """(s, predicate, value, lang, graphs): literal values other than labels, each with all graphs that say so."""
    own = quads.where((F.col("o_kind") == LITERAL) & ~F.col("p").isin(TYPE, LABEL))
    return own.groupBy("s", iri.local_name(F.col("p")).alias("predicate"), F.col("o").alias("value"), F.col("o_lang").alias("lang")).agg(F.sort_array(F.collect_set("g")).alias("graphs"))


def relationships(links: DataFrame, types: DataFrame, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): related entities of each entity in both directions with the type of the other end, at most limit for each entity; and
    their whole number by type."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    out = links.select(F.col("src").alias("id"), F.lit("outgoing").alias("direction"), "predicate", F.col("dst").alias("other"), "g")
    back = links.select(F.col("dst").alias("id"), F.lit("incoming").alias("direction"), "predicate", F.col("src").alias("other"), "g")
    both = out.unionByName(back).join(types.select(F.col("s").alias("other"), F.col("type").alias("other_type")), "other", "left")
    order = Window.partitionBy("id").orderBy("direction", "predicate", "other", "g")
    rows = both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")
    return rows, both.groupBy("id", "other_type").agg(F.count_distinct("other").alias("entities"))


def with_provenance(rows: DataFrame, provenance: DataFrame) -> DataFrame:
    """rows(g, ...) with where their graph comes from; a graph without provenance has available = false."""
    own = provenance.withColumn("available", F.lit(True))
    return rows.join(own, "g", "left").withColumn("available", F.coalesce("available", F.lit(False)))


def _escaped(c: Column) -> Column:
    for found, wanted in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(found), F.lit(wanted))
    return c


def line(q: Column | None = None) -> Column:
    """A quad's line of N-Quads."""
    o = F.when(F.col("o_kind") == URI, F.concat(F.lit("<"), "o", F.lit(">"))).when(F.col("o_kind") == "bnode", F.concat(F.lit("_:"), "o"))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise("")
    o = o.otherwise(F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tail))
    return F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" <"), "g", F.lit("> ."))


_LINE = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|_:(\S+)|"((?:[^"\\]|\\.)*+)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?) <([^>]*)> \.$'


def parsed(lines: DataFrame, graphs: list[str] | None = None) -> DataFrame:
    """Quads of lines(value); a line of another form raises. With graphs only theirs, told by the end of the line before it is taken apart."""
    if graphs is not None:
        lines = lines.where(F.regexp_extract("value", r" <([^>]*)> \.$", 1).isin(*graphs))
    part = lambda k: F.regexp_extract("value", _LINE, k)
    given = lambda k: F.nullif(part(k), F.lit(""))
    # Pairs of backslashes part the text; between them every backslash begins an escape of its own.
    parts = F.split(part(5), r"\\\\", -1)
    plain = lambda c: reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")), c)
    text = F.array_join(F.transform(parts, plain), "\\")
    kind = F.when(F.col("value").rlike(r"^<[^>]*> <[^>]*> <"), URI).when(F.col("value").rlike(r"^<[^>]*> <[^>]*> _:"), "bnode").otherwise(LITERAL)
    fine = F.when(F.col("value").rlike(_LINE), True).otherwise(F.raise_error(F.concat(F.lit("not a line of N-Quads: "), "value")).cast("boolean"))
    o = F.when(kind == URI, part(3)).when(kind == "bnode", part(4)).otherwise(text)
    return lines.where(fine).select(part(1).alias("s"), part(2).alias("p"), o.alias("o"), kind.alias("o_kind"), given(6).alias("o_lang"), given(7).alias("o_dt"), part(8).alias("g"))


def write_lines(quads: DataFrame, path: str) -> None:
    """N-Quads files, one per partition, gzipped."""
    quads.select(line().alias("value")).write.option("compression", "gzip").text(path)
