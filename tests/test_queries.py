"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from brackish.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry_points.queries(), entry_points.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(row[i] for i in order) for row in rows]
    return sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    ours = _comparable(df.columns, [tuple(r) for r in df.collect()])
    theirs = _comparable(names, result.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-4) or x == y, (a, b)
            else:
                assert x == y, (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_rows_are_not_dealt_by_year_type(spark, tmp_path):
    """Classes of the years meet the rows by broadcast, however many orders they were summed from."""
    day = "timestamp_ntz'1995-01-01' + make_dt_interval(int(id % 2000))"
    tables = {
        "lineitem": spark.range(3000).selectExpr(
            "id % 5 AS l_suppkey", f"{day} AS l_shipdate", "int(id % 6) + 1 AS l_linenumber", "double(id % 11) AS l_quantity",
            "double(id) AS l_extendedprice", "0.01 AS l_discount", "'R' AS l_returnflag",
        ),
        "orders": spark.range(20000).selectExpr(f"{day} AS o_orderdate", "double(id * 7919 % 100003) AS o_totalprice"),
        "supplier": spark.range(5).selectExpr("id AS s_suppkey", "int(id) AS s_nationkey"),
        "nation": spark.range(5).selectExpr("int(id) AS n_nationkey", "concat('N', id) AS n_name", "int(id % 2) AS n_regionkey"),
        "region": spark.range(2).selectExpr("int(id) AS r_regionkey", "concat('R', id) AS r_name"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        rows = catalog._labelled(spark, str(tmp_path))
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        kept = rows.where("drought IS NOT NULL").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 4
    assert kept == 3000


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
