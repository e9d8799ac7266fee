"""From source files to a release, on a small snapshot written here."""

from __future__ import annotations

import csv
import json

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import quads as Q
from ledgerweave.operators import release, validate
from ledgerweave.plans import build
from ledgerweave.sources import readers
from ledgerweave.sources.layouts import HEADERS

TREASURY, OFFICE, FIRM = "1000000000001", "1000000000002", "2000000000001"


def write(path, rows):
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f).writerows(rows)
    return str(path)


def review(path, kind, rows):
    width, places = readers.REVIEW[kind]
    made = [list(HEADERS[kind])]
    for row in rows:
        cells = [""] * width
        for c, v in row.items():
            cells[places[c]] = v
        made.append(cells)
    return write(path, made)


def corporation(number, name, kind, updated="2024-01-01"):
    row = [""] * readers.CORPORATION_WIDTH
    for c, v in {"corp_no": number, "name": name, "kind_code": kind, "updated_on": updated, "prefecture": "東京都"}.items():
        row[readers.CORPORATION[c]] = v
    return row


@pytest.fixture
def inputs(tmp_path):
    return made_inputs(tmp_path)


@pytest.fixture(scope="module")
def first(spark, tmp_path_factory):
    """One build that several tests look at: what it was made from, its folder, and itself."""
    folder = tmp_path_factory.mktemp("first")
    inputs = made_inputs(folder)
    return inputs, str(folder / "out"), build.build(spark, inputs, str(folder / "out"))


def made_inputs(tmp_path):
    own = {"fiscal_year": "2024", "project_id": "1"}
    law = {"law_info": {"law_id": "L1", "law_num": "平成二十年財務省令第九号", "law_num_type": "x", "promulgation_date": "2008-01-01"}, "current_revision_info": {"law_title": "甲法", "abbrev": None, "repeal_status": "None"}, "revision_info": {"amendment_law_num": "n", "amendment_enforcement_date": "2010-01-01", "current_revision_status": "s"}}
    (tmp_path / "laws.jsonl").write_text(json.dumps(law, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "ministries.csv").write_text("# note\nministry_code,name,kensei_jun\n,財務省,1\n,無い省,2\n", encoding="utf-8")
    budget = {"budget_fiscal_year": "2024", "initial": "100", "supplementary": "5", "carried_in": "0", "reserve": "0", "available": "105", "executed": "90.0", "next_year_request": "120"}
    payees = [
        own | {"block_id": "A", "block_name": "first", "role": "r", "block_amount": "70", "payee_count": "2"}, own | {"block_id": "A", "payee": "株式会社甲", "corp_no": FIRM, "amount": "60"}, own | {"block_id": "A", "payee": "その他", "other_flag": "TRUE", "amount": "10 "},
        own | {"block_id": "B", "block_name": "second", "block_amount": "30"}, own | {"block_id": "B", "payee": "乙", "amount": "20"}, own | {"block_id": "B", "payee": "職員", "corp_no": "9999999999999", "amount": "10"},
    ]
    connections = [own | {"paid": "TRUE", "block_to": "A", "block_to_name": "first"}, own | {"block_from": "A", "block_to": "B", "note": "contract"}, own | {"item": "travel", "amount": "7", "indirect_flag": "x"}]
    return build.Inputs(
        corporations=write(tmp_path / "c.csv", [corporation(TREASURY, "財務省", "101"), corporation(FIRM, "株式会社甲", "301", "2023-01-01"), corporation(FIRM, "株式会社甲", "301"), corporation(OFFICE, "別庁", "101")]),
        ministries=str(tmp_path / "ministries.csv"), laws=str(tmp_path / "laws.jsonl"),
        summary=review(tmp_path / "s.csv", "summary", [own | {"name": "事業", "ministry": "財務省"}, own | {"name": "again"}, {"fiscal_year": "2024", "project_id": "2", "name": "別事業", "ministry": "知らない省"}]),
        budget=review(tmp_path / "b.csv", "budget", [own | budget, own | {"budget_fiscal_year": "2024"}]),
        law_citations=review(tmp_path / "l.csv", "law", [own | {"law_title": "甲法（注）"}, own | {"law_id": "L9"}]),
        payees=review(tmp_path / "p.csv", "payee", payees), connections=review(tmp_path / "n.csv", "connection", connections),
    )


def test_a_release_from_files(spark, first):
    _, out, made = first
    assert made.messages == [] and made.gate.checked["block_sums"] == 2 and made.gate.checked["annual_identities"] == 1 and made.gate.checked["project_amounts"] == 1
    t = made.tables
    first = t["budget_project"].where("project_id = '1'").first()
    assert (first["ministry"], first["budget_amount"], first["basis_law"]) == (TREASURY, 100, ["L1"])
    assert {(r["label"], r["recipient_match_category"]) for r in t["expenditure"].collect()} == {("株式会社甲", "resolved"), ("その他", "bundled"), ("乙", "unresolved"), ("職員", "sentinel_or_nonexistent_houjin_bangou")}
    assert {r["corp_no"] for r in t["organization"].collect()} == {TREASURY, FIRM}
    assert {r["reason"] for r in t["unresolved_reference"].collect()} == {"NO_CANDIDATE"} and t["unresolved_reference"].count() == 3
    assert t["law"].first()["jurisdiction"] == [TREASURY] and t["law_revision"].count() == 1 and t["indirect_cost"].first()["amount"] == 7
    quads = spark.read.parquet(f"{out}/quads")
    assert quads.select("g").distinct().count() == 4 and validate.broken_references(quads).isEmpty()
    assert release.verify(quads, spark.read.parquet(f"{out}/manifest")).isEmpty()
    lines = quads.select(Q.line().alias("value"))
    assert Q.parsed(lines).exceptAll(quads.select("s", "p", "o", "o_kind", "o_lang", "o_dt", "g")).isEmpty()
    report = json.loads(spark.read.text(f"{out}/report").first()["value"])
    assert report["rows"]["expenditure"] == 4 and not any(report["faults"].values())


def test_the_gate_refuses_wrong_sums_after_the_report(spark, inputs, tmp_path):
    rows = list(csv.reader(open(inputs.payees, encoding="utf-8-sig")))
    rows[1][readers.REVIEW["payee"][1]["block_amount"]] = "71"
    write(inputs.payees, rows)
    out = str(tmp_path / "out")
    with pytest.raises(validate.ReleaseRefused, match="block_sums: 1"):
        build.build(spark, inputs, out)
    assert json.loads(spark.read.text(f"{out}/report").first()["value"])["faults"]["block_sums"] == 1
    assert build.build(spark, inputs, out, allow_partial=True).messages == ["block_sums: 1"]


def test_release_is_staged_only_if_intact(spark, first, tmp_path):
    made = first[2]
    root, declared = str(tmp_path / "served"), release.manifest(made.quads)
    release.stage(made.quads, declared, root)
    less = made.quads.where(~F.col("g").contains("rs-system"))
    with pytest.raises(ValueError, match="declares"):
        release.stage(less, declared, root)
    release.stage(less, release.manifest(less), root)
    graphs = lambda: release.served(spark, root).select("g").distinct().count()
    assert graphs() == 3
    release.rollback(spark, root)
    assert graphs() == 4
    with pytest.raises(FileNotFoundError):
        release.rollback(spark, root)
    release.publish(made.quads, str(tmp_path / "published"))
    assert release.published_is_intact(spark, str(tmp_path / "published"))


def test_a_reader_never_fails_while_releases_are_swapped(spark, tmp_path):
    import threading

    root, schema = str(tmp_path / "served"), "s string, p string, o string, o_kind string, o_lang string, o_dt string, g string"
    first, second = (spark.createDataFrame([(f"s{n}", "p", "o", "uri", None, None, f"g{n}")] * n, schema).distinct() for n in (1, 2))
    release.stage(first, release.manifest(first), root)
    seen, over = [], threading.Event()

    def read():
        while not over.is_set():
            seen.append([r["g"] for r in release.served(spark, root).collect()])

    reader = threading.Thread(target=read)
    reader.start()
    for quads in (second, first, second):
        release.stage(quads, release.manifest(quads), root, keep=3)
    release.rollback(spark, root)
    over.set()
    reader.join()
    assert seen and all(x in (["g1"], ["g2"]) for x in seen)
    assert [r["g"] for r in release.served(spark, root).collect()] == ["g1"]


def test_guards(spark, inputs):
    import dataclasses

    with pytest.raises(ValueError, match="need laws"):
        build.tables(spark, dataclasses.replace(inputs, laws=None, old_ministries="x"))


def _change(path, column, kind, value):
    rows = list(csv.reader(open(path, encoding="utf-8-sig")))
    rows[1][readers.REVIEW[kind][1][column]] = value
    write(path, rows)


def test_unchanged_graphs_are_carried_over(spark, first, inputs, tmp_path):
    import dataclasses

    _, one, made = first
    two, three = (str(tmp_path / x) for x in ("two", "three"))
    report = lambda out: json.loads(spark.read.text(f"{out}/report").first()["value"])
    counters = report(one)["counters"]
    assert len(counters) >= 40 and counters["recipient_by_houjin_bangou"] == 1 and counters["recipient_sentinel"] == 1 and counters["basis_law_by_title_stripped"] == 1
    later = dataclasses.replace(inputs, date="2024-02-01")
    again = build.build(spark, later, two, previous=one)
    assert {g.rsplit("/", 1)[1] for g in report(two)["carried_over"].values()} == {"2024-01-01"} and len(report(two)["carried_over"]) == 4
    assert again.quads.exceptAll(made.quads).isEmpty() and made.quads.exceptAll(again.quads).isEmpty()
    assert {r["o"] for r in again.provenance.where(F.col("p").endswith("generatedOn")).collect()} == {"2024-01-01"}
    # laws and ministries don't depend on the budget review, the register of payees does; of two releases back the graph keeps its date
    _change(inputs.summary, "name", "summary", "new name")
    last = build.build(spark, dataclasses.replace(inputs, date="2024-03-01"), three, previous=two)
    assert set(report(three)["carried_over"]) == {"egov-law", "ministry-codes"}
    assert sorted(r["g"].split("/graph/")[1] for r in last.quads.select("g").distinct().collect()) == ["egov-law/2024-01-01", "houjin-bangou/2024-03-01", "ministry-codes/2024-01-01", "rs-system/2024-03-01"]


def test_what_may_not_be_carried_over(spark, first, inputs, tmp_path):
    import dataclasses

    one, two = first[1], str(tmp_path / "two")
    now = build.digests(spark, inputs)
    later = dataclasses.replace(inputs, date="2024-02-01")
    assert set(build.carried(spark, later, now, one)) == {"egov-law", "houjin-bangou", "ministry-codes", "rs-system"}
    # a changed dependency forces all that are made from it
    assert build.carried(spark, later, now | {"houjin-bangou": ["other"]}, one) == {}
    assert set(build.carried(spark, later, now | {"egov-law": ["other"]}, one)) == {"houjin-bangou", "ministry-codes"}
    assert build.carried(spark, dataclasses.replace(later, payees_only=False), now, one) == {}
    with pytest.raises(FileNotFoundError, match="never shipped"):
        build.carried(spark, later, now, str(tmp_path / "nothing"))
    # a graph that breaks a shape of today is built anew, though it is as it was shipped
    quads = spark.read.parquet(f"{one}/quads")
    wrong = quads.where(~(F.col("g").contains("egov-law/") & F.col("p").endswith("lawNum")))
    wrong.write.partitionBy("g").parquet(f"{two}/quads")
    release.manifest(wrong).write.parquet(f"{two}/manifest")
    build.pointer.advance(spark, f"{two}/shipped", build.shipped(spark, one))
    assert set(build.carried(spark, later, now, two)) == {"houjin-bangou", "ministry-codes", "rs-system"}
    release.manifest(quads).write.mode("overwrite").parquet(f"{two}/manifest")
    with pytest.raises(ValueError, match="declares"):
        build.carried(spark, later, now, two)
