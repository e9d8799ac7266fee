"""The overview: the answers to ten questions, computed once and kept, and the tools that a conversation may call."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators import quads as Q
from .catalog import QUERIES

QUESTIONS = (
    "cq10_release_freshness", "cq12_government_paid_total", "cq13_money_through_stages", "cq14_budget_and_execution", "cq15_ministry_budget_ranking", "cq16_request_vs_initial", "cq17_recipient_identification", "cq18_kg_scale", "cq19_naive_sum_vs_entry_only",
    "cq20_request_exactly_granted",
)
#: Answers that may lack a value; any other null is a fault, not a zero.
OPTIONAL = {"cq13_money_through_stages": {"block_name", "source_name"}, "cq15_ministry_budget_ranking": {"name"}}


class QueryClient(Protocol):
    """What the interface needs of an engine: rows by SQL with parameters, so that no value is put into the text of a query."""

    def query(self, sql: str, **parameters: Any) -> list[dict[str, Any]]: ...


@dataclass(frozen=True)
class SparkClient:
    spark: SparkSession

    def query(self, sql: str, **parameters: Any) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.spark.sql(sql, args=parameters).collect()]


def overview(spark: SparkSession, sf_dir: str, questions: tuple[str, ...] = QUESTIONS) -> dict[str, list[dict[str, Any]]]:
    """All answers, each a few rows. A null where a value must be raises."""
    out = {}
    for name in questions:
        rows = [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]
        for row in rows:
            if lacking := [c for c, v in row.items() if v is None and c not in OPTIONAL.get(name, ())]:
                raise ValueError(f"{name}: no value for {lacking}")
        out[name] = rows
    return out


@dataclass
class Tools:
    """Tools over entities(id, type, label), edges and provenance, with the graphs that their answers came from.

    quads, where they are given, hold what an entity's attributes are. An unknown id is an error, not an empty answer.
    """

    entities: DataFrame
    edges: DataFrame
    provenance: DataFrame
    graphs: set[str] = field(default_factory=set)
    quads: DataFrame | None = None

    def schemas(self) -> list[dict[str, Any]]:
        text, number = {"type": "string"}, {"type": "integer", "minimum": 1}
        return [
            {"name": "search_entities", "parameters": {"q": text, "limit": number | {"maximum": 100}}}, {"name": "get_entity", "parameters": {"id": text}}, {"name": "get_neighborhood", "parameters": {"id": text, "depth": number | {"maximum": 2}}},
            {"name": "find_path", "parameters": {"start": text, "goal": text, "max_depth": number | {"maximum": 6}}}, {"name": "get_ontology", "parameters": {}},
        ]

    def run(self, name: str, arguments: Mapping[str, Any]) -> dict[str, Any]:
        """The answer, or an error as an answer: a wrong call doesn't end the conversation."""
        known: dict[str, Callable[..., dict[str, Any]]] = {"search_entities": self._search, "get_entity": self._entity, "get_neighborhood": self._neighborhood, "find_path": self._path, "get_ontology": self._ontology}
        if name not in known:
            return {"error": f"no such tool: {name}"}
        try:
            return known[name](**arguments)
        except (TypeError, ValueError) as e:
            return {"error": str(e)}

    def _search(self, q: str, limit: int = 20) -> dict[str, Any]:
        rows = [r.asDict() for r in Q.found(self.entities, q, limit).collect()]
        return {"hits": rows[:limit], "truncated": len(rows) > limit}

    def _entity(self, id: str) -> dict[str, Any]:
        self._known(id)
        row = self.entities.where(self.entities["id"] == id).orderBy("label").first()
        rows, groups = Q.relationships(self.edges.where((self.edges["src"] == id) | (self.edges["dst"] == id)), self.entities.selectExpr("id as s", "type"))
        own = [r.asDict() for r in rows.where(rows["id"] == id).collect()]
        said = Q.attributes(self.quads.where(self.quads["s"] == id)).orderBy("predicate", "value").collect() if self.quads is not None else []
        attributes: dict[str, list[dict[str, Any]]] = {}
        for r in said:
            attributes.setdefault(r["predicate"], []).append({"value": r["value"], "lang": r["lang"], "graphs": r["graphs"]})
        used = {r["g"] for r in own} | {g for r in said for g in r["graphs"]}
        self.graphs |= used
        others = self._described({r["other"] for r in own})
        return row.asDict() | {"attributes": attributes, "relationships": [r | {"other_label": others[r["other"]]["label"]} for r in own], "graphs": {r["g"]: r for r in self._provenance(used)}, "groups": {r["other_type"]: r["entities"] for r in groups.where(groups["id"] == id).collect()}}

    def _neighborhood(self, id: str, depth: int = 1) -> dict[str, Any]:
        self._known(id)
        return self._hydrated(graph.neighborhood(self.edges, id, depth))

    def _path(self, start: str, goal: str, max_depth: int = 4) -> dict[str, Any]:
        self._known(start, goal)
        return self._hydrated(graph.find_path(self.edges, start, goal, max_depth))

    def _known(self, *ids: str) -> None:
        have = {r["id"] for r in self.entities.where(self.entities["id"].isin(*ids)).select("id").distinct().collect()}
        if missing := [i for i in ids if i not in have]:
            raise ValueError(f"no such entity: {', '.join(missing)}")

    def _described(self, ids: set[str]) -> dict[str, dict[str, Any]]:
        """Type and label of each id, as many as a bounded answer has; an end that no graph gives a type is told as unknown."""
        rows = self.entities.where(self.entities["id"].isin(*sorted(ids))).groupBy("id").agg(F.min(F.struct("label", "type")).alias("e")).collect() if ids else []
        known = {r["id"]: {"type": r["e"]["type"], "label": r["e"]["label"]} for r in rows}
        return {i: known.get(i, {"type": "unknown", "label": None}) for i in sorted(ids)}

    def _hydrated(self, found: graph.Neighborhood | graph.Path) -> dict[str, Any]:
        used = {e[3] for e in found.edges}
        self.graphs |= used
        return vars(found) | {"entities": self._described(set(found.nodes)), "graphs": {r["g"]: r for r in self._provenance(used)}}

    def _ontology(self) -> dict[str, Any]:
        from ..schema import REFERENCES, SUPERCLASSES

        return {"superclasses": SUPERCLASSES, "references": REFERENCES}

    def sources(self) -> list[dict[str, Any]]:
        """Where the answers so far came from; a graph without provenance is told as unavailable."""
        return self._provenance(self.graphs)

    def _provenance(self, graphs: set[str]) -> list[dict[str, Any]]:
        if not graphs:
            return []
        used = self.edges.sparkSession.createDataFrame([(g,) for g in sorted(graphs)], "g string")
        return [r.asDict() for r in Q.with_provenance(used, self.provenance).orderBy("g").collect()]
