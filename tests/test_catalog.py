"""Registered queries as a whole: their names and, on the smallest tables, their SQL."""

import ast
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from dialogue_lake.plans import catalog


def as_sql_says(spark, name):
    base = duckdb.connect()
    for file in Path(entry.SMOKE).glob("*.parquet"):
        base.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    told = base.execute(entry.oracle_sql()[name])
    names = sorted(c[0] for c in told.description)
    place = {c[0]: n for n, c in enumerate(told.description)}
    wanted = Counter(tuple(r[place[c]] for c in names) for r in told.fetchall())
    found = Counter(tuple(r[c] for c in names) for r in entry.queries()[name](spark, entry.SMOKE).collect())
    assert found == wanted and found


def test_no_helper_replaces_another_of_its_name():
    for file in Path(catalog.__file__).parent.glob("*.py"):
        made = Counter(x.name for x in ast.parse(file.read_text()).body if isinstance(x, ast.FunctionDef) and x.name != "_")
        assert not [n for n, k in made.items() if k > 1], file.name


@pytest.mark.parametrize("name", ["j07_parse_decisions", "c06_decision_coverage"])
def test_saved_decisions(spark, name):
    as_sql_says(spark, name)
