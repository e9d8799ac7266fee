"""The competency questions asked of a release that was built from files."""

from __future__ import annotations

import dataclasses
import datetime
import json

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import iri
from ledgerweave.operators import quads as Q
from ledgerweave.operators import validate
from ledgerweave.plans import build
from ledgerweave.plans import competency as cq
from ledgerweave.plans.released import Released

from .test_build import FIRM, TREASURY, inputs, review  # noqa: F401

DAY = datetime.date(2024, 1, 1)


def _tree():
    cell = lambda text: {"tag": "TableColumn", "children": [text]}
    return {"tag": "Law", "children": [{"tag": "Table", "children": [{"tag": "TableRow", "children": [cell(a), cell(b)]} for a, b in (("従前の機関", "新たな機関"), ("大蔵省", "財務省"), ("郵政省", "無名省"))]}]}


@pytest.fixture
def more(inputs, tmp_path):  # noqa: F811
    law = lambda i, num, title, day, amendment: {"law_info": {"law_id": i, "law_num": num, "law_num_type": "x", "promulgation_date": "1951-01-01"}, "current_revision_info": {"law_title": title, "abbrev": None, "repeal_status": "None"}, "revision_info": {"amendment_law_num": amendment, "amendment_enforcement_date": day, "current_revision_status": "s"}}
    made = [law("L1", "平成二十年財務省令第九号", "甲法", "2010-01-01", "a"), law("L1", "平成二十年財務省令第九号", "甲法", "2012-01-01", "b"), law("L1", "平成二十年財務省令第九号", "甲法", "2030-01-01", "c"), law("L2", "昭和二十六年大蔵省令第十号", "乙令", "", ""), law("L3", "昭和二十六年逓信省令第十号", "丙令", "", "")]
    (tmp_path / "laws.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in made), encoding="utf-8")
    (tmp_path / "old.csv").write_text("# note\nname\n大蔵省\n郵政省\n", encoding="utf-8")
    (tmp_path / "succession.json").write_text(json.dumps({"law_full_text": _tree(), "revision_info": {"amendment_enforcement_date": "2001-01-06"}}, ensure_ascii=False), encoding="utf-8")
    own = {"fiscal_year": "2024", "project_id": "1"}
    parts = {"supplementary": "5", "carried_in": "0", "reserve": "0", "executed": "90"}
    budget = [own | parts | {"budget_fiscal_year": "2023", "initial": "80", "available": "85", "next_year_request": "100"}, own | parts | {"budget_fiscal_year": "2024", "initial": "100", "available": "105", "next_year_request": "120"}]
    return dataclasses.replace(inputs, old_ministries=str(tmp_path / "old.csv"), succession=str(tmp_path / "succession.json"), recorded={"egov-law": "2024-01-31"}, budget=review(tmp_path / "b2.csv", "budget", budget))


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns or frame.columns) for r in frame.collect()), key=repr)


def test_questions_of_a_release(spark, more, tmp_path):
    out = str(tmp_path / "out")
    made = build.build(spark, more, out)
    assert made.messages == [] and made.gate.faults["abolished_jurisdictions"] == 0
    t = Released.read(spark, out)
    treasury, old = f"{iri.BASE}/id/org/{TREASURY}", spark.range(1).select(iri.abolished_organ(F.lit("大蔵省"))).first()[0]
    law = lambda k: f"{iri.BASE}/id/law/L{k}"
    project, graph = f"{iri.BASE}/id/budget/2024/1", f"{iri.BASE}/graph/egov-law/2024-01-01"
    assert rows(cq.cq01_jurisdiction_of_law(t, law(2))) == [(old, "大蔵省", treasury, "財務省")]
    assert rows(cq.cq07_provenance_of_edge(t, law(1))) == [(graph, "metadata of all laws", DAY)]
    assert rows(cq.cq08_law_revision_as_of(t)) == [(law(1), datetime.date(2012, 1, 1), "b", graph)]
    assert {(s, d) for s, d in rows(cq.cq09_jurisdiction_resolution_status(t), "status", "detail")} == {("resolved", treasury), ("resolved", old), ("unresolved_old_or_obsolete_ministry", "OBSOLETE_ORGANIZATION")}
    fresh = rows(cq.cq10_release_freshness(t))
    assert len(fresh) == 5 and ("metadata of all laws", DAY, "記録日") in fresh and ("text of one law", DAY, "取得日") in fresh
    assert rows(cq.cq11_succession_of_abolished(t)) == [(law(2), old, "大蔵省", treasury, "財務省")]
    assert rows(cq.cq12_government_paid_total(t)) == [(2024, 70 + 7, 2)]
    assert rows(cq.cq13_money_through_stages(t), "project_id", "name", "block_name", "amount", "source_name") == [(project, "事業", "second", 30, "first")]
    assert rows(cq.cq14_budget_and_execution(t), "sheet_year", "budget_year", "initial", "available", "projects") == [(2024, 2023, 80, 85, 1), (2024, 2024, 100, 105, 1)]
    assert rows(cq.cq15_ministry_budget_ranking(t), "ministry", "name", "total_budget") == [(treasury, "財務省", 100)]
    assert rows(cq.cq16_request_vs_initial(t)) == [(2023, 100, 80, 1), (2024, 120, 100, 1)]
    assert rows(cq.cq20_request_exactly_granted(t)) == [(2023, 100, 100, 1, 1)]
    assert rows(cq.cq03_expenditures_of_recipient(t, f"{iri.BASE}/id/org/{FIRM}"), "name", "seq", "amount") == [("事業", 0, 60)]
    assert rows(cq.cq05_ministry_of_basis_law(t), "law_id", "ministry_name", "issuing_organ_name") == [(law(1), "財務省", "財務省")]
    counters = json.loads(spark.read.text(f"{out}/report").first()["value"])["counters"]
    assert (counters["jurisdiction_resolved"], counters["jurisdiction_resolved_abolished"], counters["recipient_bundled"], counters["projects_with_ministry"]) == (3, 1, 1, 1)


def test_failing_graphs_are_set_apart(spark, more, tmp_path, monkeypatch):
    monkeypatch.setitem(validate.SHAPES, "LawRevision", validate.SHAPES["LawRevision"] | {"revisionStatus": validate.Property(values=("current",))})
    out = str(tmp_path / "out")
    with pytest.raises(validate.ReleaseRefused, match="shape_violations"):
        build.build(spark, more, out)
    graphs = {r["g"] for r in spark.read.parquet(f"{out}/quads").select("g").distinct().collect()}
    assert f"{iri.BASE}/graph/egov-law/2024-01-01" not in graphs and len(graphs) == 4
    folder = next((tmp_path / "out" / "quarantine").iterdir())
    assert spark.read.parquet(str(folder / "violations")).where("predicate = 'revisionStatus' and rule = 'in'").count() == 3
    assert spark.read.parquet(str(folder / "quads")).where(F.col("p") == Q.TYPE).count() > 0


def test_guards_of_more_inputs(spark, more):
    for change, message in (({"old_ministries": None}, "needs old ministries"), ({"recorded": {"x": "2024-01-01"}}, "unknown sources")):
        with pytest.raises(ValueError, match=message):
            build.tables(spark, dataclasses.replace(more, **change))
