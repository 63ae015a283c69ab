"""Named queries over the TPC-H-like tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from placebook.plans.places import places_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query. ``sql`` is DuckDB text and may use ``places`` (the fixture),
    ``delivered`` (before validation) and ``master`` (after validation)."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return fn

    return add


def with_fixtures(sql: str) -> str:
    ctes = []
    if "places" in sql:
        ctes.append(f"places AS ({places_sql()})")
    if "delivered" in sql or "master" in sql:
        ctes.append(f"delivered AS ({places_sql(delivered=True)})")
    if "master" in sql:
        ctes.append("master AS (SELECT * FROM delivered WHERE trim(postal_code) <> '')")
    if not ctes:
        return sql
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {sql[5:]}"
    return f"WITH {', '.join(ctes)} {sql}"


def text(c: str) -> str:
    """SQL: the column where it says something."""
    return f"nullif(CASE WHEN trim({c}) <> '' THEN {c} END, '')"


def says(c: str) -> str:
    """SQL: true where the column says something."""
    return f"coalesce(trim({c}) <> '', false)"
