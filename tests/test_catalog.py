"""Every query against its SQL, on the smallest of the driver's tables."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect(config={"memory_limit": "4GB"})
    connection.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            connection.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, oracle, sf_dir, name):
    frame = entry.queries()[name](spark, sf_dir)
    answer = oracle.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(frame.columns)
    wanted = sorted((tuple(map(_plain, r)) for r in answer.fetchall()), key=repr)
    found = sorted((tuple(_plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert found == wanted


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["total_budget"] >= rows[-1]["total_budget"]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = entry.queries()["cq02_ministry_budget_by_year"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "o_comment" not in plan and "c_name" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
