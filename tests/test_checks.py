"""Every check passes on clean data and reports a seeded violation."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from depotflow.operators.profiling import null_census, profile_table
from depotflow.plans import checks

D1, D2 = date(2023, 1, 1), date(2023, 1, 2)


@pytest.fixture
def star(frame):
    tables = {
        "dim_date": frame("date_key int, full_date date", [(20230101, D1), (20230102, D2)]),
        "dim_warehouse": frame("warehouse_key bigint", [(1,), (2,)]),
        "dim_supplier": frame("supplier_key bigint", [(1,)]),
        "dim_sku": frame("sku_key bigint", [(1,), (2,)]),
        "fact_daily_demand": frame(
            "demand_key bigint, date_key int, sku_key bigint, warehouse_key bigint, quantity_demanded bigint, "
            "quantity_fulfilled bigint, stockout_flag boolean, revenue double",
            [(1, 20230101, 1, 1, 5, 4, True, 1.0), (2, 20230102, 2, 2, 5, 5, False, 0.0)],
        ),
        "fact_inventory_snapshot": frame(
            "snapshot_key bigint, date_key int, sku_key bigint, warehouse_key bigint, on_hand_qty bigint, available_qty bigint",
            [(1, 20230101, 1, 1, 5, 4)],
        ),
    }
    return tables, {t: tables[t] for t in ("fact_daily_demand", "fact_inventory_snapshot")}


def failed(report, name="check_name"):
    return {r[name]: (r.status, r.rows_failed) for r in report.collect() if r.status != "PASS"}


def test_star_clean(star):
    report = checks.star_checks(*star, D1, D2)
    assert report.count() == 26 and failed(report) == {}


def test_star_violations(star, frame):
    tables, sources = star
    bad = dict(tables)
    demand = tables["fact_daily_demand"].schema
    bad["fact_daily_demand"] = tables["fact_daily_demand"].unionByName(
        frame(demand, [(None, 20230101, 9, 1, -1, 4, True, -2.0), (4, 19990101, None, 7, 1, -1, False, 0.0)])
    )
    bad["fact_inventory_snapshot"] = frame(
        tables["fact_inventory_snapshot"].schema, [(None, 1, 9, 9, -5, -4), (2, 20230102, 1, 1, 1, 1)]
    )
    bad["dim_sku"] = tables["dim_sku"].unionByName(frame("sku_key bigint", [(2,), (None,)]))
    bad["dim_date"] = frame("date_key int, full_date date", [(20230101, D1), (20230102, D2), (20230102, D2), (None, None)])
    bad["dim_warehouse"] = frame("warehouse_key bigint", [(1,), (2,), (2,), (None,)])
    bad["dim_supplier"] = frame("supplier_key bigint", [(1,), (1,), (None,)])
    report = checks.star_checks(bad, sources, D1, D1)
    got = failed(report)
    assert len(got) == 26, sorted(set(r.check_name for r in report.collect()) - set(got))
    assert got["ri_fact_daily_demand_sku_key"] == ("FAIL", 1)  # the row without a key is no orphan
    assert got["dup_pk_dim_sku"] == ("FAIL", 1) and got["completeness_fact_daily_demand"][1] >= 2
    share = {r.check_name: r.failure_pct for r in report.collect()}["null_pk_dim_sku"]
    assert share == 25.0


FEATURES = """sku_id string, warehouse_id string, feature_date date, lag_1 double, rolling_avg_7 double, rolling_avg_14 double,
    rolling_avg_28 double, day_of_week int, week_of_year int, month int, quarter int, is_weekend boolean, season string"""


def feature_row(sku, day, lag, mean=1.0, week=1):
    return (sku, "W", day, lag, mean, mean, mean, 0, week, 1, 1, False, "Winter")


def test_feature_checks(frame):
    demand = frame("sku_id string, warehouse_id string, feature_date date, quantity_demanded bigint", [("a", "W", D1, 5), ("a", "W", D2, 6)])
    skus, sites = frame("sku_id string, active_flag boolean", [("a", True), ("x", False)]), frame("id string", [("W",)])
    good = frame(FEATURES, [feature_row("a", D1, 5.5), feature_row("a", D2, 5.0)])
    report = checks.feature_checks(good, demand, skus, sites)
    assert report.count() == 5 and failed(report, "check") == {}
    rows = [feature_row("a", D2, 99.0, -1.0), feature_row("a", D2, 99.0, week=None)]
    many = frame("id string", [(str(i),) for i in range(5)])
    got = failed(checks.feature_checks(frame(FEATURES, rows), demand, skus, many), "check")
    assert got == {
        "calendar_nulls": ("FAIL", 1), "rolling_avg_bounds": ("FAIL", 1), "row_count": ("FAIL", 3),
        "lag1_correctness": ("FAIL", 2), "no_duplicates": ("FAIL", 1),
    }


HISTORY = "run_id bigint, avg_mape double, n_evaluations bigint, feature_rows bigint"


def test_forecast_checks(frame):
    log = frame("step string, status string", [("a", "OK"), ("b", "UP_TO_DATE")])
    pairs = frame("sku_id string, warehouse_id string", [("a", "W"), ("a", "W"), ("b", "W")])
    forecasts = frame("sku_id string", [("a",)] * 6 + [("b",)] * 6)
    skus = frame("sku_id string, active_flag boolean", [("a", True), ("b", True), ("c", False)])
    history = frame(HISTORY, [(1, 50.0, 9, 100), (2, 60.0, 9, 100)])
    report = checks.forecast_checks(log, forecasts, pairs, skus, history, 3, 2)
    assert report.count() == 5 and failed(report, "check") == {}
    got = failed(
        checks.forecast_checks(
            frame("step string, status string", [("a", "ERROR")]), forecasts.limit(6), pairs,
            skus.withColumn("active_flag", F.lit(True)), frame(HISTORY, [(1, 50.0, 9, 100), (2, 60.1, 9, 99)]), 3, 2,
        ),
        "check",
    )
    assert got["run_steps_completed"] == ("FAIL", 1) and got["forecast_row_count"] == ("FAIL", 6)
    assert got["no_missing_skus"][0] == "FAIL" and got["mape_drift"] == ("FAIL", 0) and got["feature_store_growth"] == ("FAIL", 0)
    drift = checks.metric_drift(frame(HISTORY, [(1, None, 0, 0), (2, 10.0, 1, 5)])).orderBy("run_id").collect()
    assert [r.drift_status for r in drift] == ["WARN", "PASS"] and [r.growth_status for r in drift] == ["FAIL", "PASS"]


def test_customer_checks(frame):
    people = "customer_id string, active_flag boolean, current_rfm_segment string"
    scores = "customer_id string, recency_score int, frequency_score int, monetary_score int"
    ab = "customer_id string, test_name string, test_group string, assigned_at date, converted_flag boolean, conversion_date date"
    customers = frame(people, [(f"c{i}", True, "Champions" if i == 0 else "Lost") for i in range(10)])
    good = checks.customer_checks(customers, frame(scores, [("c1", 1, 5, 3)]), frame(ab, [("c1", "t", "test", D1, True, D2)]))
    assert good.count() == 6 and failed(good, "check") == {}
    got = failed(
        checks.customer_checks(
            customers.unionByName(frame(people, [("c1", True, "Champions")])),
            frame(scores, [("zz", 1, 5, 3), (None, 0, 1, 1)]),
            frame(ab, [("c1", "t", "test", D2, True, D1), ("c1", "t", "control", D1, False, None)]),
        ),
        "check",
    )
    assert got == {
        "no_duplicate_customers": ("FAIL", 1), "rfm_referential_integrity": ("FAIL", 2), "rfm_score_bounds": ("FAIL", 1),
        "no_ab_test_contamination": ("FAIL", 1), "conversion_date_order": ("FAIL", 1), "segment_distribution": ("FAIL", 2),
    }
    nobody = failed(checks.customer_checks(customers.limit(0), frame(scores, []), frame(ab, [])), "check")
    assert nobody == {"segment_distribution": ("WARN", 0)}


TASKS = """task_id string, warehouse_id string, task_date date, shift string, task_type string, operator_surrogate_id bigint,
    duration_min double, accuracy_flag boolean, error_code string"""


def test_task_checks(frame):
    sites = frame("warehouse_id string", [("W",)])
    rows = [(f"t{i}", "W", D1, "Night", "Pick", i % 10 + 1, 5.0, True, None) for i in range(60)]
    good = checks.task_checks(frame(TASKS, rows), sites)
    assert good.count() == 7 and failed(good, "check") == {}
    bad = rows + [(f"u{i}", "W", D1, "Night", "Pick", 11, 5.0, True, None) for i in range(900)]
    bad += [("t0", "?", D2, "Night", "Pick", 1, 0.0, True, "E1"), ("v1", None, D2, "Night", "Move", 0, 121.0, None, "")]
    got = failed(checks.task_checks(frame(TASKS, bad), sites), "check")
    assert got == {
        "duration_bounds": ("WARN", 2), "accuracy_flag_values": ("FAIL", 1), "error_code_consistency": ("WARN", 1),
        "warehouse_ref_integrity": ("FAIL", 2), "no_duplicate_task_ids": ("FAIL", 1), "daily_pick_volume": ("WARN", 2), "operator_productivity": ("WARN", 1),
    }
    assert failed(checks.task_checks(frame(TASKS, []), sites), "check") == {
        "daily_pick_volume": ("WARN", 0), "operator_productivity": ("WARN", 0),
    }


def test_profile(frame):
    rows = [(1, "a", True, D1, 1.5), (2, "a", False, D2, None), (3, "a", None, None, 3.0)]
    df = frame("row_key int, label string, on_flag boolean, day date, amount double", rows)
    by_column = {r.column: r for r in profile_table(df, "t").collect()}
    assert by_column["row_key"].mean == 2.0 and by_column["row_key"].distinct_count == 3
    assert by_column["label"].flag_low_cardinality and by_column["label"].duplicate_pct == 66.6667
    assert by_column["label"].min == "a" and by_column["label"].max is None
    assert (by_column["day"].min, by_column["day"].max) == ("2023-01-01", "2023-01-02")
    assert by_column["amount"].null_pct == 33.3333 and by_column["amount"].flag_high_nulls
    assert not by_column["on_flag"].flag_low_cardinality
    approximate = {r.column: r.distinct_count for r in profile_table(df, "t", approximate=True).collect()}
    assert approximate == {c: r.distinct_count for c, r in by_column.items()}
    empty = profile_table(df.limit(0), "t").collect()
    assert {(r.row_count, r.null_pct, r.distinct_count, r.flag_low_cardinality) for r in empty} == {(0, 0.0, 0, False)}


def test_null_census(frame):
    rows = null_census(frame("a int, b int", [(1, None), (None, None)])).collect()
    assert {r.column: (r.null_count, r.null_pct) for r in rows} == {"a": (1, 50.0), "b": (2, 100.0)}


def test_drift_compares_with_the_largest_smaller_run(frame):
    history = frame("run_id bigint, avg_mape double, n_evaluations bigint, feature_rows bigint", [(1, 10.0, 5, 100), (3, 50.0, 5, 50), (7, 51.0, 5, 60)])
    rows = {r.run_id: r for r in checks.metric_drift(history).collect()}
    assert rows[1].prior_mape is None and rows[1].drift_status == "PASS"
    assert rows[3].prior_mape == 10.0 and (rows[3].drift_status, rows[3].growth_status) == ("FAIL", "FAIL")
    assert rows[7].prior_rows == 50 and (rows[7].drift_status, rows[7].growth_status) == ("PASS", "PASS")


def test_profile_shows_small_large_and_odd_numbers(frame):
    df = frame("a double, b bigint, c double, d date", [(1e-5, 2**62, 1e25, D1), (2.0, -(2**62), float("nan"), D2), (None, 5, 1.0, D2)])
    got = {r.column: r for r in profile_table(df, "t").collect()}
    assert (got["a"]["min"], got["a"]["max"], got["a"]["distinct_count"]) == ("1.0E-5", "2.0000", 2)
    assert (got["b"]["min"], got["b"]["max"], got["b"]["distinct_count"]) == (f"{-(2**62)}.0000", f"{2**62}.0000", 3)
    assert got["c"]["max"] == "NaN" and got["c"]["mean"] != got["c"]["mean"] and got["c"]["distinct_count"] == 3
    assert (got["d"]["min"], got["d"]["max"], got["d"]["distinct_count"]) == ("2023-01-01", "2023-01-02", 2)


def test_profile_of_merged_parts_is_that_of_the_table(spark, frame):
    from depotflow.operators.profiling import column_state, merge_column_states, profile_of_state

    df = spark.range(5000).selectExpr("id", "cast(id % 97 as int) as i", "id * 0.25D as x", "concat('s', id % 300) as s", "date_add(date'2020-01-01', cast(id % 700 as int)) as d")
    states = column_state(df.filter("id % 3 = 0")).unionAll(column_state(df.filter("id % 3 <> 0")))
    for approximate in (False, True):
        merged = profile_of_state(df, merge_column_states(states), "t", approximate).collect()
        assert sorted(map(tuple, merged)) == sorted(map(tuple, profile_table(df, "t", approximate).collect()))
    exact = {r.column: r.distinct_count for r in profile_table(df, "t").collect()}
    assert exact == {"id": 5000, "i": 97, "x": 5000, "s": 300, "d": 700}
    text = profile_table(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text


def test_exact_profile_makes_no_sketches(frame):
    from depotflow.operators.profiling import column_state, profile_of_state

    df = frame("a int, b string", [(1, "x"), (2, "x"), (None, None)])
    state = column_state(df, sketches=False)
    assert "hll_sketch" not in state._jdf.queryExecution().optimizedPlan().toString()
    assert {r["column"]: r["distinct_count"] for r in profile_of_state(df, state, "t").collect()} == {"a": 2, "b": 1}
