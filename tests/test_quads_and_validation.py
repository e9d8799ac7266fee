from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import iri
from ledgerweave.operators import quads as Q
from ledgerweave.operators import release, validate

QUAD = "s string, p string, o string, o_kind string, o_lang string, o_dt string, g string"


def test_lines_round_trip(spark):
    odd = 'a "quoted" \\ back\nline\ttab\r end \\n'
    rows = [("s:1", "p:1", odd, "literal", "ja", None, "g:1"), ("s:1", "p:2", "5", "literal", None, Q.INTEGER, "g:1"), ("s:1", "p:3", "o:1", "uri", None, None, "g:2"), ("s:1", "p:4", "b1", "bnode", None, None, "g:2"), ("s:1", "p:5", "", "literal", None, None, "g:2")]
    quads = spark.createDataFrame(rows, QUAD)
    lines = quads.select(Q.line().alias("value"))
    assert sorted(map(tuple, Q.parsed(lines).collect()), key=repr) == sorted(rows, key=repr)
    assert {r["g"] for r in Q.parsed(lines, ["g:2"]).collect()} == {"g:2"}
    with pytest.raises(Exception, match="not a line"):
        Q.parsed(spark.createDataFrame([("nonsense .",)], "value string")).collect()


def test_default_graph_is_a_set(spark):
    quads = spark.createDataFrame([("s", "p", "o", "uri", None, None, "g1"), ("s", "p", "o", "uri", None, None, "g2")], QUAD)
    assert Q.triples(quads).count() == 1


def test_search_puts_rows_together_before_the_limit(spark):
    rows = [("i1", "Law", "alpha")] * 5 + [("i2", "Law", "Alphabet"), ("i3", "Expenditure", "alpha")]
    hits = Q.search(spark.createDataFrame(rows, "id string, type string, label string"), "ALPHA", 2)
    assert [r["id"] for r in hits.collect()] == ["i2", "i1"]
    with pytest.raises(ValueError, match="limit"):
        Q.search(hits, "", 0)


def law(spark, rows):
    frame = spark.createDataFrame(rows, "law_id string, num string, g string")
    return Q.emit(frame, F.concat(F.lit(f"{iri.BASE}/id/law/"), "law_id"), ["Law"], F.col("g"), {"lawNum": F.col("num")})


def test_shapes_are_per_graph_and_quarantine_holds_back(spark, tmp_path):
    quads = law(spark, [("1", "n", "good"), ("2", None, "bad"), ("3", "n", "bad")])
    found = validate.violations(quads)
    assert [(r["g"], r["class"], r["predicate"], r["rule"]) for r in found.collect()] == [("bad", "Law", "lawNum", "least")]
    assert {r["g"] for r in validate.passing(quads, found).collect()} == {"good"}
    validate.quarantined(quads, found, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q" / "quads")).select("g").distinct().collect()[0]["g"] == "bad"
    with pytest.raises(ValueError, match="no instance"):
        validate.uncovered_classes(quads.limit(0))
    assert [r["class"] for r in validate.uncovered_classes(quads, {}).collect()] == ["Law"]


def test_gate(spark):
    gate = validate.Gate()
    rows = spark.createDataFrame([(True,), (False,)], "wrong boolean")
    gate.add("sums", rows, F.col("wrong"))
    with pytest.raises(validate.ReleaseRefused, match="sums: 1"):
        gate.close()
    assert gate.close(allow_partial=True) == ["sums: 1"] and gate.checked == {"sums": 2}
    empty = validate.Gate()
    empty.add("sums", rows.limit(0), F.col("wrong"))
    assert empty.close() == []
    with pytest.raises(validate.ReleaseRefused, match="nothing was checked"):
        empty.close(must_check=("sums",))


def test_releases(spark, tmp_path):
    path = str(tmp_path / "quads")
    first = spark.createDataFrame([("s1", "p", "o", "uri", None, None, "g1"), ("s2", "p", "o", "uri", None, None, "g2")], QUAD)
    release.replace_graphs(first, path)
    release.replace_graphs(spark.createDataFrame([("s3", "p", "o", "uri", None, None, "g2")], QUAD), path)
    now = spark.read.schema(QUAD).parquet(path)
    assert {(r["s"], r["g"]) for r in now.collect()} == {("s1", "g1"), ("s3", "g2")}
    change = {r["g"]: r["change"] for r in release.difference(release.manifest(first), release.manifest(now)).collect()}
    assert change == {"g1": "same", "g2": "changed"}
    assert release.verify(now, release.manifest(now)).isEmpty() and release.verify(now, release.manifest(first)).count() == 1


def test_rebase(spark):
    quads = spark.createDataFrame([("http://a/x", "http://a/p", "http://a/y", "uri", None, None, "http://a/g"), ("http://b/x", "http://a/p", "http://a/y", "literal", None, None, "g")], QUAD)
    got = [tuple(r) for r in validate.rebased(quads, "http://a", "http://n").select("s", "o", "g").collect()]
    assert got == [("http://n/x", "http://n/y", "http://n/g"), ("http://b/x", "http://a/y", "g")]


def test_labels_or_what_describes(spark):
    at = f"{iri.BASE}/def/core#"
    rows = [("a", Q.TYPE, at + "Law", "uri"), ("a", Q.LABEL, "name", "literal"), ("b", Q.TYPE, at + "AnnualBudget", "uri"), ("b", at + "budgetFiscalYear", "2024", "literal"), ("c", Q.TYPE, at + "UnresolvedReference", "uri"), ("c", at + "text", "who", "literal"), ("d", Q.TYPE, at + "Law", "uri"), ("d", at + "text", "no", "literal")]
    quads = spark.createDataFrame([(*r, None, None, "g") for r in rows], QUAD)
    assert {r["s"]: (r["label"], r["described"]) for r in Q.labels(quads).collect()} == {"a": ("name", False), "b": ("2024", True), "c": ("who", True), "d": (None, True)}


def test_breakdowns(spark):
    detail = spark.createDataFrame([("p", "general", 3), ("p", "special", 4), ("q", "general", 1)], "project_id string, kind string, amount bigint")
    total = spark.createDataFrame([("p", 7), ("q", 2), ("r", 5)], "project_id string, amount bigint")
    assert {r["project_id"]: r["wrong"] for r in validate.breakdown_totals(detail, total, ["project_id"]).collect()} == {"p": False, "q": True}


def test_texts_of_any_characters_come_back_from_lines(spark):
    texts = ["a\u0000b", "\\n", "\\\n", '\\"', "\\\\", 'end\\', "\t\r\n\"", "\\\\\\n", ""]
    rows = spark.createDataFrame([("s", "p", t, "literal", None, None, "g") for t in texts], "s string, p string, o string, o_kind string, o_lang string, o_dt string, g string")
    assert sorted(r["o"] for r in Q.parsed(rows.select(Q.line().alias("value"))).collect()) == sorted(texts)


def test_search_takes_the_first_value_that_is_there(spark):
    rows = spark.createDataFrame([("i", "Law", "b law", None, 1), ("i", "Law", "a law", "second", 2), ("i", "Law", "c law", "third", 3)], "id string, type string, label string, place string, row_idx int")
    assert [(r["label"], r["place"]) for r in Q.search(rows, "law").collect()] == [("a law", "second")]
