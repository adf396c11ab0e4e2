"""Queries whose results must cover all rows, over tables larger or other than the given ones."""

import datetime

import duckdb
import pytest

from storelens import catalogue
from storelens.plans import graph


def test_peel_chain_follows_long_chains(spark, tmp_path):
    day = datetime.date(1992, 1, 1)
    rows = [(k * 7919 % 100003, 1 if k % 3 else 2 + k, day + datetime.timedelta(k // 2)) for k in range(600)]
    path = str(tmp_path / "orders.parquet")
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate date").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    got = sorted((r.node, r.peeled) for r in catalogue.QUERIES["peel_chain"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(catalogue.SQL["peel_chain"]).fetchall()) and len(got) == 600


def test_chain_end_of_odd_links(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (6, 5)], "node bigint, parent bigint")
    assert sorted(map(tuple, graph.chain_end(links).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (6, 5)]
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node bigint, parent bigint")
    with pytest.raises(RuntimeError):
        graph.chain_end(cycle, 5).collect()


def test_whole_change_holds_every_document(spark, sf_dir):
    old, new = catalogue._whole_change(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert [old.count(), new.count()] == [n, n] == [side.select("path").distinct().count() for side in (old, new)]
    score = catalogue.QUERIES["pr_score"](spark, sf_dir).first()
    assert score.domain_points > 0 and score.total_points == score.work_points + score.complexity_points
