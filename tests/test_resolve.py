from __future__ import annotations

import pytest

from ledgerweave.operators import resolve as V


def test_old_ministries_by_name_and_after_a_prefix(spark):
    targets = spark.createDataFrame([("総理府",), ("北海道開発庁",), ("大蔵省",), ("自治省",)], "name string")
    rows = spark.createDataFrame([(0, "大蔵省"), (1, "総理府北海道開発庁"), (2, "別の省")], "row_index int, old_name string")
    got = {tuple(r) for r in V.old_ministries(rows, targets).collect()}
    assert got == {("大蔵省", 0, "exact"), ("北海道開発庁", 1, "prefix-decomposition(総理府)")}
    twice = spark.createDataFrame([(0, "大蔵省"), (1, "総理府大蔵省")], "row_index int, old_name string")
    with pytest.raises(Exception, match="several rows"):
        V.old_ministries(twice, targets).collect()


def test_successors_by_repeated_heads(spark):
    references = spark.createDataFrame([("内閣府",), ("国家公安委員会",), ("警察庁",), ("財務省",)], "name string")
    names = spark.createDataFrame([("財務省",), ("内閣府国家公安委員会警察庁",), ("知らない省",)], "name string")
    got = {tuple(r) for r in V.successors(names, references, 4).collect()}
    assert got == {("財務省", "財務省", "exact"), ("内閣府国家公安委員会警察庁", "警察庁", "suffix-decomposition(内閣府+国家公安委員会)")}


def test_a_known_shape_of_citations(spark):
    laws = spark.createDataFrame([("L1", "甲法", None), ("L2", "乙法", ["甲乙"]), ("L3", "丙法", ["甲乙"])], "law_id string, law_title string, abbrev array<string>")
    cited = spark.createDataFrame([(0, "L1", ""), (1, "L9", "甲法"), (2, "", "甲法（注） "), (3, None, "甲乙"), (4, "", "丁法"), (5, "", None)], "i int, law_id string, law_title string")
    got = [(r["resolved"], r["method"], r["reason"], r["key"]) for r in V.basis_laws(cited, laws).orderBy("i").collect()]
    assert got == [("L1", "law_id", None, None), (None, None, "NO_CANDIDATE", "L9"), ("L1", "title_stripped", None, None), (None, None, "AMBIGUOUS", "甲乙"), (None, None, "NO_CANDIDATE", "丁法"), (None, None, None, None)]


def test_sentinels_come_before_existence_and_bundles_before_all(spark):
    lines = spark.createDataFrame([(0, "x", "9999999999999", False), (1, "x", "1111111111111", True), (2, "x", "2222222222222", False), (3, "x", "1111111111111", False), (4, "株式会社甲", "", False), (5, "乙", None, False), (6, "丙", None, False)], "i int, payee string, corp_no string, is_bundled boolean")
    numbers = spark.createDataFrame([("1111111111111",), ("9999999999999",)], "corp_no string")
    names = spark.createDataFrame([("甲", "K"), ("乙", "A"), ("乙", "B")], "name_key string, corp_no string")
    got = [(r["recipient"], r["reason"], r["category"]) for r in V.recipients(lines, numbers, names).orderBy("i").collect()]
    other = "sentinel_or_nonexistent_houjin_bangou"
    assert got == [(None, None, other), (None, None, "bundled"), (None, None, other), ("1111111111111", None, "resolved"), ("K", None, "resolved"), (None, "AMBIGUOUS", "unresolved"), (None, "NO_CANDIDATE", "unresolved")]
    assert V.recipients(lines, numbers).where("i = 4").first()["reason"] == "NO_CANDIDATE"


def test_successors_of_any_number_of_parts(spark):
    parts = [f"{c}省" for c in "甲乙丙丁戊己庚辛壬癸"]
    references = spark.createDataFrame([(p,) for p in parts], "name string")
    names = spark.createDataFrame([("".join(parts),)], "name string")
    assert [r["successor"] for r in V.successors(names, references).collect()] == ["癸省"]
    with pytest.raises(ValueError, match="open after 8"):
        V.successors(names, references, 8)
