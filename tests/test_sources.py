from __future__ import annotations

import csv
import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from ledgerweave.sources import lake, readers, rest
from ledgerweave.sources.layouts import HEADERS


def rows_file(path, rows, bom=False):
    text = io.StringIO()
    csv.writer(text).writerows(rows)
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.getvalue().encode())
    return str(path)


def corporation(number, name="n"):
    row = [""] * readers.CORPORATION_WIDTH
    row[1], row[6], row[8] = number, name, "101"
    return row


def test_corporations_from_text_and_archive(spark, tmp_path):
    rows = [corporation("1234567890123", 'a "b", c'), corporation("x"), corporation("9999999999999", "two\nlines")]
    plain = rows_file(tmp_path / "c.csv", rows)
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.write(plain, "c.csv")
    for path in (plain, str(tmp_path / "c.zip")):
        got = [(r["corp_no"], r["name"], r["row_idx"]) for r in readers.corporations(spark, path).orderBy("row_idx").collect()]
        assert got == [("1234567890123", 'a "b", c', 0), ("9999999999999", "two\nlines", 2)]
    with pytest.raises(readers.LayoutError, match="corporate number"):
        readers.corporations(spark, rows_file(tmp_path / "bad.csv", [corporation("x")] * 3))


def test_review_headers_and_widths(spark, tmp_path):
    for kind, (width, columns) in readers.REVIEW.items():
        assert len(HEADERS[kind]) == width and max(columns.values()) < width
    width, columns = readers.REVIEW["summary"]
    header = list(HEADERS["summary"])
    row = [str(i) for i in range(width)]
    path = rows_file(tmp_path / "s.csv", [header, row], bom=True)
    got = readers.review(spark, path, "summary").first()
    assert (got["project_id"], got["ministry"], got["row_idx"]) == ("2", "5", 0)
    with pytest.raises(Exception, match="unexpected header"):
        readers.review(spark, rows_file(tmp_path / "d.csv", [header[::-1], row]), "summary").collect()
    with pytest.raises(Exception, match="columns"):
        readers.review(spark, rows_file(tmp_path / "t.csv", [header, row[:-1]]), "summary").collect()


def test_commented_table(spark, tmp_path):
    (tmp_path / "m.csv").write_text("# a note\ncode,name\n# another\n1,x\n", encoding="utf-8")
    assert [tuple(r) for r in readers.commented(spark, str(tmp_path / "m.csv"), ["code", "name"]).collect()] == [("1", "x")]


def test_laws(spark, tmp_path):
    line = lambda k, abbrev: json.dumps({"law_info": {"law_id": k, "law_num": "n", "law_num_type": "t", "promulgation_date": "2024-01-02"}, "current_revision_info": {"law_title": "x", "abbrev": abbrev, "repeal_status": "None"}, "revision_info": None})
    (tmp_path / "laws.jsonl").write_text("\n".join([line("1", None), line("2", "a"), line("3", ["a", "b"])]), encoding="utf-8")
    got = {r["law_id"]: (r["abbrev"], str(r["promulgation_date"])) for r in readers.laws(spark, str(tmp_path / "laws.jsonl")).collect()}
    assert got == {"1": ([], "2024-01-02"), "2": (["a"], "2024-01-02"), "3": (["a", "b"], "2024-01-02")}


def test_api_records_shift_what_was_executed(spark):
    rows = spark.createDataFrame([([("007", "n", "m", "2024", [("2024", "10", "4"), ("2025", "12", None)])],)], "rows array<struct<project_id: string, name: string, ministry: string, fiscal_year: string, budgets: array<struct<year: string, initial: string, executed: string>>>>")
    projects, annual = readers.api_records(rows)
    assert projects.first()["project_id"] == "7"
    assert {(r["budget_fiscal_year"], r["initial"], r["executed"]) for r in annual.collect()} == {(2023, None, 4), (2024, 10, None), (2025, 12, None)}


def test_lake(spark, tmp_path):
    at = str(tmp_path / "lake")
    calls = []
    fetcher = lambda: calls.append(1) or b"content"
    assert lake.fetch(spark, at, "law", "2024-01-01", "f", fetcher) and not lake.fetch(spark, at, "law", "2024-01-01", "f", fetcher)
    assert len(calls) == 1 and lake.load(spark, at, "law", "2024-01-01", "f") == b"content"
    with pytest.raises(FileExistsError):
        lake.save(spark, at, "law", "2024-01-01", "f", b"other")
    lake.save(spark, at, "law", "2024-02-01", "a", b"x")
    lake.save(spark, at, "law", "2024-02-01", "b", b"x")
    assert tuple(lake.latest(lake.manifest(spark, at)).first())[2] == "b"
    before = lake.latest_before(lake.manifest(spark, at), F.lit("2024-01-31").cast("date")).first()
    assert (str(before["date"]), before["file"]) == ("2024-01-01", "f")
    with pytest.raises(FileNotFoundError):
        lake.load(spark, at, "law", "2020-01-01", "f")


class _Pages(BaseHTTPRequestHandler):
    total, fail = 25, {"left": 1}

    def do_GET(self):  # noqa: N802
        if self.fail["left"]:
            self.fail["left"] -= 1
            self.send_response(503)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        offset = int(self.path.split("offset=")[1])
        rows = [{"id": i} for i in range(offset, min(offset + 10, self.total))]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"rows": rows, "count": len(rows), "total_count": self.total}).encode())

    def log_message(self, *_):
        pass


def test_paged_source(spark):
    server = HTTPServer(("127.0.0.1", 0), _Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(rest.PagedSource)
    read = lambda total: spark.read.format("paged").option("url", f"http://127.0.0.1:{server.server_port}/").option("total", total).option("page", 10).load()
    rows = rest.complete(read(25), 25)
    assert sorted(json.loads(r["row"])["id"] for r in rows.collect()) == list(range(25))
    with pytest.raises(Exception, match="in all"):
        read(30).collect()
    with pytest.raises(ValueError, match="25 rows of 26"):
        rest.complete(rows, 26)
    server.shutdown()


def test_inventory(spark):
    schema = "id string, updated_at string"
    start = spark.createDataFrame([("1", "a"), ("2", "b")], schema)
    cached = spark.createDataFrame([("1", "a", True), ("2", "b", False)], schema + ", intact boolean")
    assert [r["id"] for r in rest.to_fetch(start, cached).collect()] == ["2"]
    assert rest.unchanged(start, start) and not rest.unchanged(start, start.limit(1))
    files = spark.createDataFrame([("a", bytearray(b"PK\x03")), ("b", bytearray(b"<html>"))], "path string, content binary")
    assert [r["is_zip"] for r in rest.is_zip(files).orderBy("path").collect()] == [True, False]


def _api_page(*rows):
    return json.dumps({"results": list(rows)}).encode()


def _api_row(k, **changed):
    return {"id": f"u{k}", "project_number": f"00{k}", "name": "n", "fiscal_year": 2024, "is_published": True, "finalized_amount_for_initial_budget": 10, "previous_year_execution_amount": 4, "budget_data": [{"fiscal_year": 2024, "initial_budgets_total_amount": 10}]} | changed


def test_an_api_snapshot_is_checked_as_a_whole(spark):
    import hashlib

    from ledgerweave.sources import api_snapshot

    def checked(*pages, reported=None, sha=None, rows=None):
        made = [(f"p{k}", bytearray(p)) for k, p in enumerate(pages)]
        told = [(f"p{k}", sha or hashlib.sha256(p).hexdigest(), rows or len(json.loads(p)["results"])) for k, p in enumerate(pages)]
        return api_snapshot.checked(spark.createDataFrame(made, "file string, content binary"), spark.createDataFrame(told, api_snapshot.MANIFEST), reported or sum(len(json.loads(p)["results"]) for p in pages), 2024)

    assert checked(_api_page(_api_row(1), _api_row(2)), _api_page(_api_row(3))).count() == 3
    for pages, more, said in (([_api_page(_api_row(1))], {"sha": "0" * 64}, "other bytes"), ([_api_page(_api_row(1))], {"rows": 2}, "other numbers"), ([_api_page(_api_row(1))], {"reported": 5}, "5 reported"), ([_api_page(_api_row(1, fiscal_year=2023))], {}, "other years"), ([_api_page(_api_row(1, is_published=False))], {}, "unpublished"), ([_api_page(_api_row(1)), _api_page(_api_row(1))], {}, "ids twice")):
        with pytest.raises(readers.LayoutError, match=said):
            checked(*pages, **more)
    rows = lambda *x: checked(_api_page(*x))
    projects, annual = api_snapshot.records(rows(_api_row(1), _api_row(2, budget_data=None), _api_row(3, previous_year_execution_amount=None, budget_data=[{"fiscal_year": 2023, "initial_budgets_total_amount": 7}])), 2024)
    assert sorted((r["project_id"], r["budget_amount"]) for r in projects.collect()) == [("1", 10), ("2", 10), ("3", 10)]
    assert sorted(((r["project_id"], r["budget_fiscal_year"], r["initial"], r["executed"]) for r in annual.collect()), key=repr) == [("1", 2023, None, 4), ("1", 2024, 10, None), ("2", 2023, None, 4), ("3", 2023, 7, None)]
    twice = [{"fiscal_year": 2023, "initial_budgets_total_amount": 1}] * 2
    for bad, said in ((rows(_api_row(1, finalized_amount_for_initial_budget=9)), "list and history"), (rows(_api_row(1, project_number="１")), "not a number"), (rows(_api_row(1), _api_row(2, project_number="01")), "a number twice"), (rows(_api_row(1, budget_data=twice)), "a year twice")):
        with pytest.raises(Exception, match=said):
            [x.collect() for x in api_snapshot.records(bad, 2024)]


def test_connectors_look_before_they_keep(spark, tmp_path, monkeypatch, capsys):
    from ledgerweave.sources import connectors

    answers = {"http://r/all.zip": b"PK\x03\x04", "http://l/L1": b'{"law_full_text": {}}', "http://l/L2": b"<html>", "http://l/L3": b'{"message": "none"}'}
    monkeypatch.setattr(connectors, "get", lambda url: answers.get(url, b"PK" if "good" in url else b"<html>"))
    at = str(tmp_path / "lake")
    assert connectors.main([at, "2024-01-01", "--register", "http://r/all.zip", "--laws", "http://l", "--law", "L1", "--review", "http://bad", "--year", "2024"], spark) == 1
    said = capsys.readouterr().out
    assert "houjin-bangou: fetched" in said and "egov-law-data: fetched" in said and "rs-system: failed" in said and "isn't an archive" in said
    assert {(r["source"], r["file"]) for r in lake.manifest(spark, at).collect()} == {("houjin-bangou", "register.zip"), ("egov-law-data", "law_data_L1.json")}
    assert connectors.main([at, "2024-01-01", "--review", "http://good", "--year", "2024", "--group", "summary"], spark) == 0
    for law_id, match in (("L2", "isn't JSON"), ("L3", "no text")):
        with pytest.raises(connectors.UnexpectedContent, match=match):
            connectors.law("http://l", law_id)[f"law_data_{law_id}.json"]()
    with pytest.raises(SystemExit):
        connectors.main([at, "2024-01-01", "--review", "http://good"], spark)


def test_rows_are_numbered_over_files(spark, tmp_path):
    for name, k in (("b é.csv", 2), ("a.csv", 1)):
        (tmp_path / name).write_text(f"x{k},y\nz{k},w\n", encoding="utf-8")
    got = readers.csv_rows(spark, str(tmp_path), 2, {"first": 0}).orderBy("row_idx").collect()
    assert [r["first"] for r in got] == ["x1", "z1", "x2", "z2"] and got[0]["row_idx"] == 0
