"""Every query of the catalogue against its SQL, over the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from storelens import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted(repr([r[n] for n in names]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    mine, theirs = catalogue.QUERIES[name](spark, sf_dir).toArrow(), duck.sql(catalogue.SQL[name]).to_arrow_table()
    assert sorted(mine.column_names) == sorted(theirs.column_names)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_optional_part():
    root = Path(catalogue.__file__).parent
    found = [p for p in root.rglob("*.py") if "llm" not in p.parts and "storelens.llm" in p.read_text()]
    assert found == []
