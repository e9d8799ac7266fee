from __future__ import annotations

import pytest

from ledgerweave.operators import records as R


def test_deduplication_takes_the_latest_then_the_later_row(spark):
    rows = spark.createDataFrame([("1", "a", "2024-01-01", 0), ("1", "b", "2024-01-01", 1), ("1", "c", "", 2), ("2", "d", None, 0)], "corp_no string, name string, updated_on string, row_idx bigint")
    assert {(r["corp_no"], r["name"]) for r in R.deduplicated_organizations(rows).collect()} == {("1", "b"), ("2", "d")}


def test_aggregate_rows(spark):
    schema = "project_id string, budget_fiscal_year int, initial string"
    fine = spark.createDataFrame([("1", 2024, "5"), ("1", 2024, ""), ("2", 2024, " ")], schema)
    assert [(r["project_id"], r["initial"]) for r in R.aggregate_budget_rows(fine, ["project_id"]).collect()] == [("1", "5")]
    with pytest.raises(Exception, match="aggregate rows"):
        R.aggregate_budget_rows(spark.createDataFrame([("1", 2024, "5"), ("1", 2024, "6")], schema), ["project_id"]).collect()
    with pytest.raises(Exception, match="aggregate rows"):
        R.aggregate_budget_rows(fine, ["project_id"], optional=False).collect()


CONNECTION = "project_id string, row_idx bigint, block_from string, block_from_name string, paid string, block_to string, block_to_name string, note string, indirect_flag string, item string, amount string"


def connections(spark):
    return spark.createDataFrame(
        [
            ("p", 0, "", "", "TRUE", "A", "first", "", "", "", ""), ("p", 1, "A", "first", "", "B", "", "note 1", "", "", ""), ("p", 2, "C", "third", "", "B", "second", "note 2", "", "", ""),
            ("p", 3, "A", "", "", "B", "", "note 1", "", "", ""), ("p", 4, "", "", "", "", "", "", "x", "travel", "1,000"), ("p", 5, "", "", "", "", "", "", "x", "travel", "2"), ("p", 6, "", "", "", "", "", "", "", "", ""),
        ],
        CONNECTION,
    )


def test_connection_kinds(spark):
    kinds = [r["kind"] for r in R.connection_kinds(connections(spark)).orderBy("row_idx").collect()]
    assert kinds == ["paid", "edge", "edge", "edge", "indirect", "indirect", "empty"]
    with pytest.raises(Exception, match="unknown form"):
        R.connection_kinds(spark.createDataFrame([("p", 0, "A", "", "", "", "", "", "", "", "")], CONNECTION)).collect()


def test_blocks_come_from_attributes_and_both_ends(spark):
    attributes = spark.createDataFrame([("p", "A", "own name", "role", 10, 2)], "project_id string, block_id string, block_name string, role string, amount bigint, payee_count bigint")
    got = {r["block_id"]: r for r in R.blocks(attributes, connections(spark)).collect()}
    assert set(got) == {"A", "B", "C"}
    assert (got["A"]["block_name"], got["A"]["paid_by_government"], got["A"]["funded_by"], got["A"]["amount"]) == ("own name", True, [], 10)
    assert (got["B"]["block_name"], got["B"]["funded_by"], got["B"]["flow_notes"], got["B"]["amount"]) == ("second", ["A", "C"], ["note 1", "note 2"], None)
    assert got["C"]["block_name"] == "third" and not got["C"]["paid_by_government"]


def test_indirect_costs_take_the_first_of_equal_items(spark):
    assert [tuple(r) for r in R.indirect_costs(connections(spark)).collect()] == [("p", "travel", 1000)]


PAYEE = "project_id string, row_idx bigint, payee string, corp_no string, other_flag string, amount string, contract_amount string, block_id string, role string, block_name string, block_amount string, payee_count string"


def test_expenditures(spark):
    rows = spark.createDataFrame(
        [
            ("p", 0, "", "", "", "", "", "A", "old role", "n", "30", "2"), ("p", 1, " x ", "123", "", "10", "", "A", "", "", "", ""), ("p", 2, "その他", "9", "FALSE", "20", "", "A", "", "", "", ""),
            ("p", 3, "y", "", "", "", "5", "A", "", "", "", ""), ("p", 4, "z", "", "", "", "", "A", "", "", "", ""), ("p", 5, "", "", "", "", "", "A", "new role", "m", "40", ""),
        ],
        PAYEE,
    )
    got = R.expenditures(rows).orderBy("seq").collect()
    assert [(r["seq"], r["payee"], r["corp_no"], r["is_bundled"], r["amount"], r["role"]) for r in got] == [(0, "x", "123", False, 10, "new role"), (1, "その他", None, True, 20, "new role")]
    assert [r["kind"] for r in R.payee_kinds(rows).orderBy("row_idx").collect()] == ["block", "kept", "kept", "contract_detail", "missing_amount", "block"]
    assert [(r["block_name"], r["amount"], r["payee_count"]) for r in R.block_attributes(rows).collect()] == [("m", 40, None)]


def test_files_around_a_spine(spark):
    spine = spark.createDataFrame([("1", 0, "a"), ("1", 1, "b"), ("2", 2, "c")], "k string, row_idx bigint, name string")
    side = spark.createDataFrame([("1", 5, "y"), ("1", 4, "x"), ("9", 6, "z")], "k string, row_idx bigint, v string")
    got = {r["k"]: (r["name"], [x["v"] for x in r["side"]]) for r in R.around_spine(spine, "k", side=side).collect()}
    assert got == {"1": ("a", ["x", "y"]), "2": ("c", [])}
