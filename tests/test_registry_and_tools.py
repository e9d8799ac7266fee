from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import freshness
from ledgerweave.plans import overview
from ledgerweave.sources import lake, registry, succession


def test_registry(spark, tmp_path):
    registry.check()
    with pytest.raises(ValueError, match="wrong entry"):
        registry.check({"a": registry.Source("b", "n", "bulk")})
    sources = registry.frame(spark)
    fetched = spark.createDataFrame([("houjin-bangou", "2024-01-01"), ("egov-law", "2024-02-01")], "source string, date string").withColumn("date", F.to_date("date"))
    stale = {r["source"]: r["days"] for r in freshness.stale(sources, fetched, F.lit("2024-02-10").cast("date")).collect()}
    assert stale == {"houjin-bangou": 40, "rs-system": None}
    with pytest.raises(ValueError, match="no source"):
        freshness.stale(sources.limit(0), fetched, F.lit("2024-02-10").cast("date"))


def test_one_failing_source_does_not_stop_others(spark, tmp_path):
    def fail():
        raise OSError("no answer")

    files = {f"{t.replace('{year}', '2024')}.zip": (lambda g=g: g.encode()) for g, t in registry.GROUPS.items()}
    wanted = {"egov-law": {"laws.jsonl": fail}, "rs-system": files}
    root = str(tmp_path)
    assert registry.fetch_all(spark, root, "2024-01-01", wanted) == {"egov-law": "failed: no answer", "rs-system": "fetched"}
    assert registry.fetch_all(spark, root, "2024-01-01", {"rs-system": files}) == {"rs-system": "skipped"}
    assert set(registry.group_files(lake.manifest(spark, root), "2024-01-01")) == set(registry.GROUPS)
    with pytest.raises(FileNotFoundError):
        registry.group_files(lake.manifest(spark, root), "2024-01-02")


def cell(text):
    return {"tag": "TableColumn", "children": [{"tag": "Sentence", "children": [text]}]}


def table(*rows):
    return {"tag": "Table", "children": [{"tag": "TableRow", "children": [cell(c) for c in r]} for r in rows]}


def test_succession_table(spark):
    tree = {"tag": "Law", "children": [table(("other", "table"), ("x", "y")), {"tag": "Body", "children": [table(("新たな機関", "従前の機関"), ("財務省", "大蔵省（造幣局を除く。）"), ("", "x"))]}]}
    laws = spark.createDataFrame([("L", json.dumps(tree, ensure_ascii=False))], "law_id string, tree string")
    rows = succession.succession_rows(laws).orderBy("row_index").collect()
    assert [(r["row_index"], r["old_name"], r["new_name"], r["dropped"]) for r in rows] == [(1, "大蔵省", "財務省", False), (2, "x", "", True)]
    for wrong, message in ((table(("a", "b"), ("1", "2")), "0 tables"), (table(("従前", "新"), ("1", "2", "3")), "3 cells")):
        with pytest.raises(Exception, match=message):
            succession.succession_rows(spark.createDataFrame([("L", json.dumps(wrong))], "law_id string, tree string")).collect()


def test_succession_table_in_a_table(spark):
    """A cell's text has all that is below it; a table within a cell is a table of its own; a law with two tables raises."""
    inner = table(("従前", "新"), ("a", "b"))
    outer = {"tag": "Table", "children": [{"tag": "Row", "children": [{"tag": "C", "children": ["x", {"tag": "Ruby", "text": "y", "children": ["z"]}]}, {"tag": "C", "children": [inner]}]}]}
    one = spark.createDataFrame([("L", json.dumps(outer, ensure_ascii=False))], "law_id string, tree string")
    assert [(r["row_index"], r["old_text"], r["new_text"]) for r in succession.succession_rows(one).collect()] == [(1, "a", "b")]
    two = spark.createDataFrame([("L", json.dumps({"tag": "Law", "children": [inner, inner]}, ensure_ascii=False))], "law_id string, tree string")
    with pytest.raises(Exception, match="2 tables"):
        succession.succession_rows(two).collect()


def test_abolished_ministries(spark):
    assert succession.abolition_date('{"revision_info": {"amendment_enforcement_date": "2001-01-06"}}') == "2001-01-06"
    with pytest.raises(ValueError):
        succession.abolition_date('{"revision_info": {}}')
    with pytest.raises(ValueError):
        succession.law_document("{}", "L")
    successors = spark.createDataFrame([("大蔵省", "財務省")], "name string, successor string")
    ministries = spark.createDataFrame([("財務省", "1")], "name string, corp_no string")
    assert succession.abolished(successors, ministries, "2001-01-06").first()["succeeded_by"] == ["1"]
    with pytest.raises(Exception, match="no such ministry"):
        succession.abolished(successors, ministries.limit(0), "2001-01-06").collect()


def test_overview(spark, sf_dir):
    got = overview.overview(spark, sf_dir)
    assert set(got) == set(overview.QUESTIONS) and all(got.values())
    assert overview.SparkClient(spark).query("select :x as x", x="a' or 1=1") == [{"x": "a' or 1=1"}]


def test_tools(spark):
    entities = spark.createDataFrame([("l", "Law", "Alpha"), ("m", "Ministry", "Beta")], "id string, type string, label string")
    edges = spark.createDataFrame([("l", "m", "jurisdiction", "g1")], "src string, dst string, predicate string, g string")
    provenance = spark.createDataFrame([("g1", "register")], "g string, source_name string")
    tools = overview.Tools(entities, edges, provenance)
    assert {s["name"] for s in tools.schemas()} == {"search_entities", "get_entity", "get_neighborhood", "find_path", "get_ontology"}
    assert [h["id"] for h in tools.run("search_entities", {"q": "alp"})["hits"]] == ["l"]
    assert tools.run("find_path", {"start": "l", "goal": "m"})["found"] and tools.run("get_neighborhood", {"id": "l"})["nodes"] == ["l", "m"]
    assert tools.run("get_entity", {"id": "m"})["groups"] == {"Law": 1}
    assert "error" in tools.run("get_entity", {"id": "zz"}) and "error" in tools.run("nothing", {}) and "error" in tools.run("get_neighborhood", {"id": "l", "depth": 9})
    assert [(s["source_name"], s["available"]) for s in tools.sources()] == [("register", True)]


def test_entity_detail_and_hydrated_answers(spark):
    entities = spark.createDataFrame([("l", "Law", "Alpha"), ("m", "Ministry", "Beta")], "id string, type string, label string")
    edges = spark.createDataFrame([("l", "m", "jurisdiction", "g1"), ("l", "x", "basisLaw", "g3")], "src string, dst string, predicate string, g string")
    provenance = spark.createDataFrame([("g1", "register"), ("g2", "laws")], "g string, source_name string")
    core = "http://d/def/core#"
    quads = spark.createDataFrame([("l", core + "lawNum", "n", "literal", None, None, g) for g in ("g2", "g1")] + [("l", core + "jurisdiction", "m", "uri", None, None, "g1")], "s string, p string, o string, o_kind string, o_lang string, o_dt string, g string")
    tools = overview.Tools(entities, edges, provenance, quads=quads)
    got = tools.run("get_entity", {"id": "l"})
    assert got["attributes"] == {"lawNum": [{"value": "n", "lang": None, "graphs": ["g1", "g2"]}]}
    assert {g: r["available"] for g, r in got["graphs"].items()} == {"g1": True, "g2": True, "g3": False}
    assert {r["other"]: r["other_label"] for r in got["relationships"]} == {"m": "Beta", "x": None}
    near = tools.run("get_neighborhood", {"id": "l"})
    assert near["entities"] == {"l": {"type": "Law", "label": "Alpha"}, "m": {"type": "Ministry", "label": "Beta"}, "x": {"type": "unknown", "label": None}}
    assert tools.run("find_path", {"start": "m", "goal": "l"})["entities"]["m"]["label"] == "Beta"
    assert tools.run("get_neighborhood", {"id": "zz"}) == {"error": "no such entity: zz"} and tools.run("find_path", {"start": "l", "goal": "zz"}) == {"error": "no such entity: zz"}


def test_search_tells_of_more_at_every_limit(spark):
    entities = spark.createDataFrame([(f"{i:03}", "Law", "same") for i in range(101)] + [("000", "Ministry", "zzz same")], "id string, type string, label string")
    tools = overview.Tools(entities, spark.createDataFrame([], "src string, dst string, predicate string, g string"), spark.createDataFrame([], "g string, source_name string"))
    full = tools.run("search_entities", {"q": "SAME", "limit": 100})
    assert len(full["hits"]) == 100 and full["truncated"] and full["hits"][0] == {"id": "000", "label": "same", "type": "Law"}
    assert "error" in tools.run("search_entities", {"q": "", "limit": 101})
