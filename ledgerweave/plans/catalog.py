"""All queries by name, and for most the SQL that gives the same rows from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .harness import PRELUDE, Harness

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True) -> Callable:
    """Registers a function of a Harness under its name; sql follows the CTEs of PRELUDE unless prelude is false."""

    def registered(f: Callable[[Harness], DataFrame]) -> Callable[[Harness], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Harness(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = (PRELUDE if prelude else "") + sql
        return f

    return registered


def load() -> None:
    """Imports the modules that register queries."""
    from . import checks, competency, derived, linked  # noqa: F401


load()
