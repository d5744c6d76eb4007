"""The jobs from CSV files to marts, run twice."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from depotflow.bindings import TestTables
from depotflow.jobs import Jobs
from depotflow.operators.experiments import Trial
from depotflow.sources.files import export_csv
from depotflow.sources.tables import TableStore, log_steps

FOLDER = "/root/testdata/sf0.001"
FIRST, LAST = date(1995, 1, 1), date(2001, 12, 31)


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    """The source files of all four products, written from the test tables."""
    folder, t = str(tmp_path_factory.mktemp("sources")), TestTables(spark, FOLDER)
    columns = dict(zip(["task_id", "operator_id", "warehouse_id", "sku_id"], ["Task_ID", "Operator_ID", "Warehouse_ID", "SKU_ID"]))
    files = {
        "sku_master": t.item_source, "daily_demand": t.demand_source, "inventory_snapshot": t.inventory_source,
        "suppliers": t.supplier_source, "customers": t.customer_source, "outbound_orders": t.order_source,
        "wms_tasks": t.task_source.withColumnsRenamed(columns),
        "warehouse_locations": t.location_batch(3).withColumnsRenamed({"location_id": "Location_ID", "warehouse_id": "Warehouse_ID",
            "zone": "Zone", "aisle": "Aisle", "bay": "Bay", "level": "Level", "capacity_units": "Capacity_Units",
            "storage_type": "Storage_Type", "active_flag": "Active_Flag"}),
    }
    for name, df in files.items():
        export_csv(df, f"{folder}/{name}.csv")
    return folder


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return TableStore(spark, str(tmp_path_factory.mktemp("tables")))


def jobs(spark, store, sources, day=1):
    return Jobs(spark, store, sources, datetime(2024, 1, day))


def test_star_and_forecast(spark, store, sources, tmp_path):
    j, t = jobs(spark, store, sources), TestTables(spark, FOLDER)
    results = j.load_star(t.sites, FIRST, LAST)
    assert [r.status for r in results] == ["OK"] * 6 and results[4].rows_loaded == t.demand_source.count()
    assert j.check_star(FIRST, LAST).filter("status <> 'PASS'").count() == 0
    # the date watermark: nothing new, then everything again after the facts were emptied
    assert j.load_new_demand(date(2001, 1, 1)) == ("ALREADY_CURRENT", 0)
    assert j.load_new_demand(date(2030, 1, 1)) == ("NO_NEW_DATA", 0)
    full = store.read("fact_daily_demand")
    store.refresh("fact_daily_demand", full.filter(F.col("date_key") <= 19991231))
    store_rows = store.read("fact_daily_demand").count()
    status, rows = j.load_new_demand(LAST)
    assert status == "OK" and store_rows + rows == full.count()
    again = store.read("fact_daily_demand")
    assert again.agg(F.count_distinct("demand_key"), F.max("demand_key")).first()[:] == (full.count(),) * 2
    measures = ["date_key", "sku_key", "warehouse_key", "quantity_demanded", "revenue"]
    assert again.select(*measures).exceptAll(full.select(*measures)).count() == 0

    assert j.update_features() == ("UP_TO_DATE", 0)  # the default mark lies after the test data
    assert j.update_features(date(1990, 1, 1))[0] == "OK"
    assert j.update_features() == ("UP_TO_DATE", 0)
    series = j._active_demand().filter(F.col("feature_date") >= date(2001, 5, 9)).select("sku_id", "warehouse_id").distinct()
    assert j.forecast(basis_days=180) == series.count() * 90
    assert j.evaluate(FIRST, date(2001, 8, 5), date(2001, 11, 4)) > 0
    plan = j.planner_forecast()
    assert plan.count() == series.count() * 30 and plan.columns[0] == "SKU_ID"
    assert j.record_metrics(1).count() == 1 and j.record_metrics(2).count() == 2
    log_steps(store, [("features", "OK", 1, 0.1, ""), ("models", "OK", 1, 0.1, "")], F.lit("2024-01-01 00:00:00").cast("timestamp"), 1)
    report = j.check_forecast(basis_days=180)
    # an active item that was not ordered in the basis window has no forecast
    assert {r.check for r in report.collect() if r.status != "PASS"} <= {"no_missing_skus"}
    assert j.check_features().filter("check = 'no_duplicates' and status = 'PASS'").count() == 1
    j.save_report(report, "monitoring", str(tmp_path))
    j.save_report(report, "monitoring", str(tmp_path))
    assert store.read("report_monitoring").count() == 10
    assert j.profile("dim_sku").count() == len(store.read("dim_sku").columns)


def test_customers_and_trial(spark, store, sources):
    j = jobs(spark, store, sources)
    assert j.load_customers().count() == 150
    assert j.load_orders() == ("OK", 1500) and j.load_orders() == ("UP_TO_DATE", 0)
    people = j.load_customers()  # a second delivery keeps the metrics
    assert people.agg(F.sum("lifetime_orders")).first()[0] == 1500
    shares = j.score_customers()
    assert abs(shares.agg(F.sum("pct_of_total")).first()[0] - 100) < 0.1
    jobs(spark, store, sources, day=2).score_customers()
    history = store.read("fact_rfm_scores")
    assert history.count() == 300 and history.filter("is_current_flag").count() == 150
    assert history.filter("not is_current_flag and valid_to is null").count() == 0
    trial = Trial("at_risk_mail", "", "At Risk", "rate", date(2000, 8, 1), date(2001, 8, 1))
    first = j.run_trial(trial, date(2000, 8, 1)).first()
    second = j.run_trial(trial, date(2000, 8, 1)).first()
    assert first == second and first.n_test + first.n_control > 0
    assert {r.check for r in j.check_customers().collect() if r.status != "PASS"} <= {"segment_distribution"}


def test_warehouse_and_marts(spark, store, sources, tmp_path):
    j = jobs(spark, store, sources)
    assert j.load_locations().count() == 200
    assert jobs(spark, store, sources, day=2).load_locations().count() == 200
    assert j.load_tasks() == ("OK", 1000) and j.load_tasks() == ("UP_TO_DATE", 0)
    pending = j.recommend_slots().count()
    assert pending > 0 and jobs(spark, store, sources, day=2).recommend_slots().count() == pending
    assert j.refresh_pairs().count() > 0
    assert j.check_tasks(store.read("dim_location")).filter("status = 'FAIL'").count() == 0
    j.publish_marts(str(tmp_path / "marts"))
    for name in j.marts():
        exported = spark.read.option("header", True).csv(str(tmp_path / "marts" / name)).count()
        assert exported == spark.table(name).count() > 0, name
