"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run and keep their schema."""

import os

import duckdb
import numpy as np
import pytest

from woodlot import queries as Q

D = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return float(v) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(map(plain, r)) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(Q.QUERIES[name](spark, D).toPandas()) == rows(duck.sql(Q.SQL[name]).df())


@pytest.mark.parametrize("name", ["bag_digest", "leaf_rules", "tree_dump"])
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, D).count() > 0


def test_rules_select_the_rows_that_reach_the_leaf(spark):
    frame = Q.order_frame(spark, D)
    frame.createOrReplaceTempView("order_frame")
    walked = {(r.tree_id, r.node_id): r.n for r in Q.tree_walk(spark, D).groupBy("tree_id", "node_id").count().withColumnRenamed("count", "n").collect()}
    for r in Q.leaf_rules(spark, D).collect():
        assert spark.sql(f"SELECT count(*) AS n FROM order_frame WHERE {r.rule}").first().n == walked.get((r.tree_id, r.node_id), 0)


def test_plans_push_columns_down(spark):
    plan = Q.split_reg_numeric(spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_shipdate" not in plan.split("ReadSchema")[-1]
    assert "PythonUDF" not in plan
