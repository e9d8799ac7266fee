"""Tables of an ontology that is given as quads: labels of classes and predicates, values of enums, and the axis each class is under.

Classes and predicates have a title and a fragment as their local name. A value of an enum is a class whose fragment is Enum/value, directly below the
enum; a predicate whose range has such classes is of that enum. Axes are the classes directly below the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import recursive
from .quads import TYPE, URI

OWL, RDFS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#"
TITLE, SUBCLASS, RANGE = "http://purl.org/dc/terms/title", f"{RDFS}subClassOf", f"{RDFS}range"
KINDS = {f"{OWL}Class": "type", f"{OWL}ObjectProperty": "predicate", f"{OWL}DatatypeProperty": "predicate"}


def _fragment(c: str) -> Column:
    """What follows the last #; null without one."""
    return F.when(F.col(c).contains("#"), F.substring_index(c, "#", -1))


def _titles(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("p") == TITLE).groupBy("s").agg(F.min("o").alias("label"))


def labels(quads: DataFrame) -> DataFrame:
    """(kind, name, label) of classes (kind type) and predicates that have a title. Values of enums are no types."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("o")]
    declared = quads.where((F.col("p") == TYPE) & F.col("o").isin(*KINDS)).select("s", kind.alias("kind")).groupBy("s").agg(F.max("kind").alias("kind"))
    own = declared.join(_titles(quads), "s").select("kind", _fragment("s").alias("name"), "label")
    return own.where(~F.col("name").contains("/"))


def _below(quads: DataFrame) -> DataFrame:
    """(sub, super) by local names; restrictions, which have no address, are left out."""
    own = quads.where((F.col("p") == SUBCLASS) & (F.col("o_kind") == URI)).select(_fragment("s").alias("sub"), _fragment("o").alias("super"))
    return own.where("sub is not null and super is not null").distinct()


def enum_values(quads: DataFrame) -> DataFrame:
    """(predicate, value, label) of the values that have a title of predicates whose range is an enum."""
    ranges = quads.where(F.col("p") == RANGE).select(_fragment("s").alias("predicate"), _fragment("o").alias("enum")).where("predicate is not null")
    titles = _titles(quads).select(_fragment("s").alias("sub"), "label")
    values = _below(quads).where(F.col("sub").contains("/")).join(titles, "sub").select(F.col("super").alias("enum"), F.expr("substring(sub, instr(sub, '/') + 1)").alias("value"), "label")
    return ranges.join(values, "enum").select("predicate", "value", "label").distinct()


def axes(quads: DataFrame, root: str = "Entity") -> DataFrame:
    """(name, axis) of the classes under the root, but not the root: the nearest axis at or above each, of several equally near the least.

    The way up is recursive SQL with visited classes, so a cycle ends.
    """
    below = _below(quads).where(~F.col("sub").contains("/") & ~F.col("super").contains("/"))
    top = below.where(F.col("super") == root).select(F.col("sub").alias("super")).distinct()
    found = recursive.closure(below).where(F.col("sub") != root).join(top, "super")
    return found.groupBy(F.col("sub").alias("name")).agg(F.min(F.struct("depth", "super")).alias("m")).select("name", F.col("m.super").alias("axis"))
