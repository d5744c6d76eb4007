"""Shape of the physical plans: what must not happen at scale."""

import re

import pytest
from pyspark.sql import Window, functions as F

from depotflow.catalog import QUERIES, Products
from depotflow.operators import joins
from depotflow.plans import warehouse

FOLDER = "/root/testdata/sf0.001"
PLANS_TO_CHECK = sorted(set(QUERIES) - {"streamed_orders", "streamed_lines"})


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df)


@pytest.mark.parametrize("name", PLANS_TO_CHECK)
def test_no_cross_join_no_row_udf_no_single_task_window(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "EvalPython" not in text and "InPandas" not in text
    assert single_task_windows(text) == []


def single_task_windows(text: str) -> list[str]:
    """Windows fed by an exchange into one partition."""
    return re.findall(r"Window (\[.*)\n.*Sort .*\n.*Exchange SinglePartition", text)


def test_single_task_windows_are_recognised(spark):
    naive = spark.range(9).withColumn("n", F.row_number().over(Window.orderBy("id")))
    assert len(single_task_windows(plan(naive))) == 1


def test_features_use_one_shuffle_for_all_windows(spark):
    products = Products(spark, FOLDER)
    from depotflow.plans.forecasting import feature_store

    series = products.t.series
    exchanges = lambda df: plan(df).count("Exchange hashpartitioning")
    assert exchanges(feature_store(series)) - exchanges(series) == 1


def test_top_n_cuts_rows_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    text = plan(joins.first_per_key(df, ["k"], ["id"], 50))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_only_needed_columns_are_read(spark):
    text = plan(warehouse.daily_kpis(Products(spark, FOLDER).plain_tasks()))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "event_id" not in schema


def test_watermark_reaches_the_scan(spark, tmp_path):
    from datetime import date

    from depotflow.operators.versions import after_watermark

    spark.sql("select date'2024-01-01' as d, 1 as x").write.parquet(str(tmp_path / "t"))
    text = plan(after_watermark(spark.read.parquet(str(tmp_path / "t")), "d", date(2023, 1, 1), date(2024, 6, 1)))
    assert "GreaterThan(d,2023-01-01)" in text and "LessThanOrEqual(d,2024-06-01)" in text


def test_a_hot_key_is_split_in_a_shuffled_lookup(spark, tmp_path):
    """A third of the fact has one key and the dimension is too big to broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        fact = spark.range(0, 300000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).cast("string").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")
        )
        dim = spark.range(5000).select(F.col("id").cast("string").alias("nk"), F.col("id").alias("key"))
        joined = joins.lookup(fact, dim, {"k": "nk"}, ["key"])
        text = executed(joined)
        assert "skew=true" in text
        assert joined.filter("key = 7").count() == 100000 + 40
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_large_session_is_joined_in_blocks(spark):
    from depotflow.operators.baskets import BLOCK_ITEMS, prefix_matches

    items = BLOCK_ITEMS * 3
    members = spark.range(items).selectExpr("'A' as site", "1L as s", "format_string('i%05d', id) as item", "1L as c", "2L as n", "1.0D as t")
    pairs = prefix_matches(members, "site")
    assert pairs.count() == items * (items - 1) // 2 and "_block" in plan(pairs)


@pytest.fixture
def staged_plans(monkeypatch):
    """Plans of everything a query writes while it is built."""
    from pyspark.sql.readwriter import DataFrameWriter

    seen, write = [], DataFrameWriter.parquet

    def recorded(self, *args, **options):
        seen.append(plan(self._df))
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    return seen


@pytest.mark.parametrize("name", ["fact_daily_demand", "fact_inventory_snapshot"])
def test_lines_are_not_shuffled_to_find_their_site(spark, staged_plans, name):
    text = "\n".join([plan(QUERIES[name](spark, FOLDER)), *staged_plans])
    assert "l_orderkey" not in text and "lineitem" in text
    assert "hashpartitioning(l_suppkey" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_stored_star_tables_are_read_once(spark, staged_plans, tmp_path):
    """Row rules, references, repeated keys and counts of a fact come from one pass over it and one count of its source."""
    from datetime import date

    from depotflow.plans import checks

    p = Products(spark, FOLDER)
    built = {
        "dim_date": p.month_end_dates(), "dim_warehouse": p.sites(), "dim_supplier": p.suppliers(), "dim_sku": p.skus(),
        "fact_daily_demand": p.demand(), "fact_inventory_snapshot": p.inventory(),
    }
    for name, df in built.items():
        df.write.parquet(f"{tmp_path}/{name}")
    staged_plans.clear()
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in built}
    report = checks.star_checks(tables, {n: tables[n] for n in checks.FACTS}, date(1995, 1, 1), date(2001, 6, 30))
    rows = report.collect()
    text = "\n".join([plan(report).split("Initial Plan")[0], *staged_plans])
    assert len(rows) == 26 and all(r["rows_failed"] == 0 for r in rows if r["check_name"].startswith("dup"))
    for table in checks.FACTS:
        assert text.count(f"/{table}]") <= 2, table
    assert "hashpartitioning(demand_key" not in text and "hashpartitioning(sku_key" not in text


def test_lines_are_shuffled_once_for_their_item(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for source, day in (("demand_source", "ship_date"), ("inventory_source", "day")):
            text = plan(getattr(Products(spark, FOLDER).t, source))
            keys = re.findall(r"Exchange hashpartitioning\((\w+)#", text)
            assert day not in keys and "l_partkey" not in keys and "SKU_ID" in keys
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
