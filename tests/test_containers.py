"""Containers are followed to the outermost one, however deep."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from symloom.operators import graph as G
from symloom.operators import lookup as L
from symloom.queries import QUERIES

DEPTH, SF = 16, "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def nested(spark):
    rows = [(str(i), f"n{i}", "class" if i == 0 else "method", str(i - 1) if i else None) for i in range(DEPTH)]
    rows += [("x", "x", "method", "y"), ("y", "y", "method", "x")]
    return spark.createDataFrame(rows, "id string, name string, kind string, container_id string")


def test_chains_end_at_the_root_or_on_a_cycle(nested):
    up = nested.filter("container_id is not null").select(F.col("id").alias("child"), F.col("container_id").alias("parent"))
    want = {(str(i), str(j), i - j) for i in range(DEPTH) for j in range(i)} | {("x", "y", 1), ("y", "x", 1)}
    assert {tuple(r) for r in G.closure(up).collect()} == want
    with pytest.raises(RuntimeError):
        G.closure(up, 5)
    last = nested.filter(F.col("id") == str(DEPTH - 1)).select("id")
    assert {r[0] for r in G.with_ancestors(nested, last).collect()} == {str(i) for i in range(DEPTH)}
    assert {tuple(r) for r in G.enclosing_types(nested).collect()} == {(str(i), "0") for i in range(DEPTH)}


def test_name_paths_are_whole(nested):
    got = {r["id"]: r["name_path"] for r in L.name_paths(nested).collect()}
    assert got[str(DEPTH - 1)] == "/".join(f"n{i}" for i in range(DEPTH))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_name_path_equals_recursive_sql(spark):
    sql = f"""WITH RECURSIVE c AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, CASE WHEN p_partkey // 2 > 0 THEN p_partkey // 2 END AS up FROM '{SF}/part.parquet'),
    walk AS (SELECT id, up, name AS path FROM c UNION ALL SELECT walk.id, c.up, concat(c.name, '/', path) FROM walk JOIN c ON c.id = walk.up)
    SELECT CAST(id AS VARCHAR), arg_max(path, length(path)) FROM walk GROUP BY id"""
    assert {tuple(r) for r in QUERIES["name_path"](spark, SF).select("id", "name_path").collect()} == set(duckdb.sql(sql).fetchall())
