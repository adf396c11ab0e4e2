"""Queries with SQL, and those without, over the smallest tables."""

import os

import duckdb
import pytest

from storelens.llm import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted(repr([r[n] for n in names]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    mine, theirs = registry.QUERIES[name](spark, sf_dir).toArrow(), duck.sql(registry.SQL[name]).to_arrow_table()
    assert sorted(mine.column_names) == sorted(theirs.column_names)
    assert rows(mine) == rows(theirs)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
