"""Registered queries: a function of the record tables and, where possible, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogue_lake.plans import sql_views
from dialogue_lake.plans.views import Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql_views.with_views(sql)
        return build

    return register


def view(name: str, sql: str) -> None:
    sql_views.VIEWS[name] = sql


def listed(column: Column | str, separator: str = ",") -> Column:
    """An array as text, for comparison with SQL results."""
    return F.array_join(column, separator)
