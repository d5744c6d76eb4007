"""The twins once more on test tables in which one key of each kind holds a third of the rows."""

import shutil

import duckdb
import pytest
from compare import BASE_TABLES, connect, differences

from __spark_entry__ import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
# One item, supplier and customer take every third row; one operator at one moment takes every third task.
HOT = {
    "lineitem": "SELECT * EXCLUDE (n) REPLACE (CASE WHEN n % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey, "
    "CASE WHEN n % 3 = 0 THEN 3 ELSE l_suppkey END AS l_suppkey, "
    "CASE WHEN n % 3 = 0 THEN TIMESTAMP '2001-10-01' ELSE l_shipdate END AS l_shipdate) "
    "FROM (SELECT *, row_number() OVER () AS n FROM '{}')",
    "orders": "SELECT * EXCLUDE (n) REPLACE (CASE WHEN n % 3 = 0 THEN 11 ELSE o_custkey END AS o_custkey) "
    "FROM (SELECT *, row_number() OVER () AS n FROM '{}')",
    "events": "SELECT * EXCLUDE (n) REPLACE (CASE WHEN n % 3 = 0 THEN 5 ELSE user_id END AS user_id, "
    "CASE WHEN n % 3 = 0 THEN TIMESTAMP '2024-01-20 09:00:00' ELSE ts END AS ts, "
    "CASE WHEN n % 3 = 0 THEN 'click' ELSE event_type END AS event_type) "
    "FROM (SELECT *, row_number() OVER () AS n FROM '{}')",
}
HOT_QUERIES = [
    "fact_daily_demand", "fact_inventory_snapshot", "supplier_two_hop", "demand_features", "baseline_forecasts",
    "model_evaluation", "orders_clean", "rfm_scores", "segment_performance", "ab_outcomes", "operator_dim", "operator_scorecard",
    "sku_velocity", "slotting_recommendations", "cooccurrence_lift", "dq_wms", "column_profile", "streamed_lines",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    target = tmp_path_factory.mktemp("hot")
    for t in BASE_TABLES:
        if t in HOT:
            duckdb.sql(f"COPY ({HOT[t].format(f'{FOLDER}/{t}.parquet')}) TO '{target}/{t}.parquet' (FORMAT parquet)")
        else:
            shutil.copy(f"{FOLDER}/{t}.parquet", target)
    return str(target)


@pytest.mark.parametrize("name", HOT_QUERIES)
def test_twin_on_hot_keys(spark, folder, name):
    assert differences(queries()[name](spark, folder), connect(folder), oracle_sql()[name]) == []
