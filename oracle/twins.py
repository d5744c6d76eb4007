"""One SQL query per named query; DuckDB runs them on the same Parquet tables."""

from __future__ import annotations

from oracle.views import LAST_SHIP, SIX_DIGITS, calendar, customers_with, evaluation, features, rfm, velocity, with_views

N = "format('{:,}', CAST("  # thousands separators


def _n(x: str) -> str:
    return f"{N}{x} AS BIGINT))"


def _row(name: str, checked: str, failed: str, detail: str, status: str | None = None, level: str = "FAIL") -> str:
    """SELECT list of one report row; detail and status may use c (checked) and f (failed)."""
    status = status or f"CASE WHEN f = 0 THEN 'PASS' ELSE '{level}' END"
    return f"""SELECT '{name}' AS "check", {status} AS status, c AS rows_checked, f AS rows_failed, {detail} AS detail
        FROM (SELECT CAST({checked} AS BIGINT) AS c, CAST({failed} AS BIGINT) AS f)"""


def _rule(name: str, table: str, breaks: str, detail: str, level: str = "FAIL", applies: str = "true") -> str:
    return _row(
        name, f"(SELECT count(*) FROM {table} WHERE {applies})", f"(SELECT count(*) FROM {table} WHERE ({applies}) AND ({breaks}))",
        detail, level=level,
    )


def _all(rows: list[str]) -> str:
    return "\nUNION ALL\n".join(rows)


def _star_report() -> str:
    dims = {"dim_date": "date_key", "dim_warehouse": "warehouse_key", "dim_supplier": "supplier_key", "dim_sku": "sku_key"}
    views = {
        "dim_date": "stock_dates", "dim_warehouse": "sites", "dim_supplier": "star_suppliers", "dim_sku": "star_skus",
        "fact_daily_demand": "star_demand", "fact_inventory_snapshot": "star_stock",
    }
    facts = {"fact_daily_demand": "demand_key", "fact_inventory_snapshot": "snapshot_key"}
    source = {
        "fact_daily_demand": "SELECT DISTINCT ship_date, l_partkey, warehouse_id FROM ship_lines",
        "fact_inventory_snapshot": "SELECT DISTINCT last_day(ship_date), l_partkey, warehouse_id FROM ship_lines",
    }
    rows = []
    for table, key in {**dims, **facts}.items():
        rows.append(_rule(f"null_pk_{table}", views[table], f"{key} IS NULL", f"'{table}.{key}'"))
    for table, key in dims.items():
        view = views[table]
        rows.append(
            _row(
                f"dup_pk_{table}", f"(SELECT count(*) FROM {view})",
                f"(SELECT count(*) FROM (SELECT {key} FROM {view} GROUP BY 1 HAVING count(*) > 1))", f"'{table}.{key}'",
            )
        )
    for table in facts:
        view = views[table]
        for dim in ("dim_date", "dim_sku", "dim_warehouse"):
            fk = dims[dim]
            rows.append(
                _rule(
                    f"ri_{table}_{fk}", view, f"{fk} IS NOT NULL AND {fk} NOT IN (SELECT {fk} FROM {views[dim]})",
                    f"'{fk} in {dim}'",
                )
            )
        late = "date_key IN (SELECT date_key FROM stock_dates WHERE full_date NOT BETWEEN DATE '1995-01-01' AND DATE '2001-06-30')"
        rows.append(_rule(f"date_range_{table}", view, late, "'1995-01-01 .. 2001-06-30'"))
        rows.append(
            _row(
                f"completeness_{table}", f"(SELECT count(*) FROM ({source[table]}))",
                f"abs((SELECT count(*) FROM {view}) - (SELECT count(*) FROM ({source[table]})))",
                f"'source=' || {_n('c')} || ', loaded=' || {_n('c - f')}",
            )
        )
    for table, cols in (
        ("fact_daily_demand", ("quantity_demanded", "quantity_fulfilled")),
        ("fact_inventory_snapshot", ("on_hand_qty", "available_qty")),
    ):
        for c in cols:
            rows.append(_rule(f"qty_non_negative_{table}_{c}", views[table], f"{c} < 0", f"'{table}.{c}'"))
    rows.append(_rule("revenue_non_negative", "star_demand", "revenue < 0", "''"))
    rows.append(
        _rule(
            "stockout_consistency", "star_demand", "quantity_fulfilled > quantity_demanded",
            "'more fulfilled than demanded'", applies="stockout_flag",
        )
    )
    return _star_layout(rows)


def _star_layout(rows: list[str]) -> str:
    return f"""SELECT "check" AS check_name, status, rows_checked, rows_failed,
        CASE WHEN rows_checked > 0 THEN round(rows_failed / rows_checked * 100, 4) ELSE 0.0 END AS failure_pct, detail
        FROM ({_all(rows)})"""


def _demand_report() -> str:
    """The rows of the star report that concern the demand fact, and its repeated keys."""
    repeated = _row(
        "dup_pk_fact_daily_demand", "(SELECT count(*) FROM star_demand)",
        "(SELECT count(*) FROM (SELECT demand_key FROM star_demand GROUP BY 1 HAVING count(*) > 1))", "'fact_daily_demand.demand_key'",
    )
    return f"""SELECT * FROM ({_star_report()}) WHERE check_name LIKE '%fact_daily_demand%' OR check_name IN ('revenue_non_negative', 'stockout_consistency')
        UNION ALL {_star_layout([repeated])}"""


def _feature_report() -> str:
    total = "(SELECT count(*) FROM series_features)"
    pairs = """(SELECT lag_1, quantity_demanded FROM series_features f JOIN series d ON d.sku_id = f.sku_id
        AND d.warehouse_id = f.warehouse_id AND d.feature_date = f.feature_date - 1)"""
    cols = ["day_of_week", "week_of_year", "month", "quarter", "is_weekend", "season"]
    nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in cols)
    skus, sites = "(SELECT count(DISTINCT sku_id) FROM series_items WHERE active_flag)", "(SELECT count(*) FROM region)"
    return _all(
        [
            _row("calendar_nulls", total, f"(SELECT {nulls} FROM series_features)", f"{_n('f')} || ' empty cells'"),
            _row(
                "rolling_avg_bounds", total,
                "(SELECT count(*) FROM series_features WHERE rolling_avg_7 < 0 OR rolling_avg_14 < 0 OR rolling_avg_28 < 0)",
                f"{_n('f')} || ' below zero'",
            ),
            _row(
                "row_count", total, f"greatest({skus} * {sites} - {total}, 0)",
                f"""{_n("c")} || ' of at least ' || {_n(f"{skus} * {sites}")}""",
            ),
            _row(
                "lag1_correctness", f"(SELECT count(*) FROM {pairs})",
                f"(SELECT count(*) FROM {pairs} WHERE abs(lag_1 - quantity_demanded) > 0.01)",
                f"{_n('f')} || ' of ' || {_n('c')} || ' differ'",
                "CASE WHEN c = 0 OR f * 100.0 / c <= 5 THEN 'PASS' ELSE 'FAIL' END",
            ),
            _row(
                "no_duplicates", total,
                """(SELECT count(*) FROM (SELECT 1 FROM series_features GROUP BY sku_id, warehouse_id, feature_date
                    HAVING count(*) > 1))""",
                f"{_n('f')} || ' repeated keys'",
            ),
        ]
    )


DRIFT = """SELECT h.run_id, round(h.avg_mape, 4) AS avg_mape, round(p.avg_mape, 4) AS prior_mape,
    round((h.avg_mape - p.avg_mape) / p.avg_mape * 100, 1) AS drift_pct,
    CASE WHEN h.avg_mape IS NULL OR h.n_evaluations = 0 THEN 'WARN'
         WHEN (h.avg_mape - p.avg_mape) / p.avg_mape > 0.2 THEN 'FAIL' ELSE 'PASS' END AS drift_status,
    h.n_evaluations, h.feature_rows, p.feature_rows AS prior_rows,
    CASE WHEN h.feature_rows > 0 AND (p.feature_rows IS NULL OR h.feature_rows >= p.feature_rows) THEN 'PASS' ELSE 'FAIL' END
        AS growth_status
    FROM metric_history h LEFT JOIN metric_history p ON p.run_id = (SELECT max(run_id) FROM metric_history WHERE run_id < h.run_id)"""


def _run_report() -> str:
    expected = "(SELECT count(DISTINCT (sku_id, warehouse_id)) * 90 FROM basis)"
    within = f"c BETWEEN {expected} * 0.8 AND {expected} * 1.2"
    last = "(SELECT * FROM drift ORDER BY run_id DESC LIMIT 1)"
    return f"""SELECT * FROM (WITH drift AS ({DRIFT}) {_all([
        _row("run_steps_completed", "(SELECT count(*) FROM metric_history)", "0", f"{_n('f')} || ' of ' || {_n('c')} || ' not completed'"),
        _row(
            "forecast_row_count", "(SELECT count(*) FROM forecasts)",
            f"(SELECT CASE WHEN {within} THEN 0 ELSE abs(c - {expected}) END FROM (SELECT count(*) AS c FROM forecasts))",
            f"{_n('c')} || ' where ' || {_n(expected)} || ' are usual'",
        ),
        _row(
            "no_missing_skus", "(SELECT count(DISTINCT sku_id) FROM series_items WHERE active_flag)",
            "(SELECT count(DISTINCT sku_id) FROM series_items WHERE active_flag AND sku_id NOT IN (SELECT sku_id FROM forecasts))",
            f"{_n('f')} || ' of ' || {_n('c')} || ' not forecast'",
        ),
        f'''SELECT 'mape_drift', drift_status, n_evaluations, 0, printf('%.4f', avg_mape)
            || coalesce(' after ' || printf('%.4f', prior_mape), ' first run') FROM {last}''',
        f'''SELECT 'feature_store_growth', growth_status, feature_rows, 0,
            {_n('feature_rows')} || ' after ' || coalesce({_n('prior_rows')}, '') FROM {last}''',
    ])})"""  # fmt: skip


def _customer_report() -> str:
    champions = "(SELECT count(*) FROM custdim WHERE active_flag AND current_rfm_segment = 'Champions')"
    return _all(
        [
            _row(
                "no_duplicate_customers", "(SELECT count(*) FROM custdim)",
                "(SELECT count(*) - count(DISTINCT customer_id) FROM custdim)",
                f"'total=' || {_n('c')} || ', distinct=' || {_n('c - f')} || ', duplicates=' || {_n('f')}",
            ),
            _rule(
                "rfm_referential_integrity", "scores", "customer_id NOT IN (SELECT customer_id FROM custdim)",
                f"{_n('f')} || ' of ' || {_n('c')} || ' unknown'",
            ),
            _rule(
                "rfm_score_bounds", "scores",
                "recency_score NOT BETWEEN 1 AND 5 OR frequency_score NOT BETWEEN 1 AND 5 OR monetary_score NOT BETWEEN 1 AND 5",
                f"{_n('f')} || ' of ' || {_n('c')} || ' outside 1..5'",
            ),
            _row(
                "no_ab_test_contamination", "(SELECT count(*) FROM outcomes)",
                """(SELECT count(*) FROM (SELECT 1 FROM outcomes GROUP BY customer_id, test_name
                    HAVING count(DISTINCT test_group) > 1))""",
                f"{_n('f')} || ' in both groups'",
            ),
            _rule(
                "conversion_date_order", "outcomes", "assigned_at >= conversion_date",
                f"{_n('f')} || ' of ' || {_n('c')} || ' too early'",
                applies="converted_flag AND conversion_date IS NOT NULL",
            ),
            _row(
                "segment_distribution", "(SELECT count(*) FROM custdim WHERE active_flag AND current_rfm_segment IS NOT NULL)",
                f"""(SELECT CASE WHEN {champions} * 100.0 <= 15 * count(*) THEN 0 ELSE {champions} END FROM custdim
                    WHERE active_flag AND current_rfm_segment IS NOT NULL)""",
                f"{_n(champions)} || ' of ' || {_n('c')}",
                "CASE WHEN c = 0 THEN 'WARN' WHEN f = 0 THEN 'PASS' ELSE 'FAIL' END",
            ),
        ]
    )


def _task_report() -> str:
    daily = "(SELECT count(*) AS n FROM tasks WHERE task_type = 'Pick' GROUP BY warehouse_id, task_date)"
    shifts = "(SELECT count(*) AS n FROM loaded_tasks WHERE operator_surrogate_id > 0 GROUP BY operator_surrogate_id, task_date, shift)"
    of = f"{_n('f')} || ' of ' || {_n('c')}"
    status = "CASE WHEN c > 0 AND f = 0 THEN 'PASS' ELSE 'WARN' END"
    return _all(
        [
            _rule(
                "duration_bounds", "tasks", "duration_min <= 0 OR duration_min > 120",
                f"{of} || ' out of bounds'", "WARN",
            ),
            _rule("accuracy_flag_values", "tasks", "accuracy_flag IS NULL", f"{_n('f')} || ' empty'"),
            _rule(
                "error_code_consistency", "tasks", "accuracy_flag AND error_code NOT IN ('', 'None')",
                f"{_n('f')} || ' accurate with a code'", "WARN",
            ),
            _rule("warehouse_ref_integrity", "tasks", "warehouse_id IS NULL OR warehouse_id NOT IN ('WH-0', 'WH-1')", f"{of} || ' unknown'"),
            _row(
                "no_duplicate_task_ids", "(SELECT count(*) FROM tasks)", "(SELECT count(*) - count(DISTINCT task_id) FROM tasks)",
                f"'total=' || {_n('c')} || ', distinct=' || {_n('c - f')} || ', duplicates=' || {_n('f')}",
            ),
            _row(
                "daily_pick_volume", f"(SELECT count(*) FROM {daily})", f"(SELECT count(*) FROM {daily} WHERE n NOT BETWEEN 50 AND 500)",
                f"'site days out of band: ' || {of}", status,
            ),
            _row(
                "operator_productivity", f"(SELECT count(*) FROM {shifts})",
                f"""(SELECT count(*) FROM {shifts}, (SELECT avg(n) AS mean, stddev_samp(n) AS std FROM {shifts})
                    WHERE abs(n - mean) > 3 * std)""",
                f"'shifts far from the mean: ' || {of}", status,
            ),
        ]
    )


def _profile() -> str:
    kinds = {
        "star_demand": ("fact_daily_demand", """demand_key bigint, date_key int, sku_key bigint, warehouse_key bigint,
            abc_class string, xyz_class string, quantity_demanded bigint, quantity_fulfilled bigint, quantity_unfulfilled bigint,
            stockout_flag boolean, revenue double, fill_rate double"""),
        "star_skus": ("dim_sku", """sku_key bigint, sku_id string, category string, abc_class string, xyz_class string,
            unit_cost double, unit_price double, weight_kg double, volume_cbm double, storage_type string, supplier_id string,
            lead_time_days bigint, min_order_qty bigint, safety_stock_qty bigint, reorder_point_qty bigint,
            primary_warehouse string, active_flag boolean"""),
    }
    rows = []
    for view, (table, columns) in kinds.items():
        for column in columns.split(","):
            name, kind = column.split()
            numeric = kind in ("bigint", "int", "double")
            shown = "CAST(CAST({}({}) AS DECIMAL(28,4)) AS VARCHAR)" if numeric else "CAST({}({}) AS VARCHAR)"
            mean = f"CAST(sum(CAST({name} AS DECIMAL(28,4))) AS DOUBLE) / count({name})" if numeric else "CAST(NULL AS DOUBLE)"
            rows.append(
                f"""SELECT '{table}' AS "table", '{name}' AS "column", '{kind}' AS data_type, count(*) AS row_count,
                count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS distinct_count,
                {shown.format("min", name)} AS "min", {shown.format("max", name) if numeric else "CAST(NULL AS VARCHAR)"} AS "max",
                round({mean}, 4) AS mean FROM {view}"""
            )
    return f"""SELECT *, null_pct > 5 AS flag_high_nulls,
        distinct_count > 0 AND duplicate_pct > 50 AND NOT contains("column", 'key') AND NOT contains("column", 'flag')
            AS flag_low_cardinality
        FROM (SELECT *, round(null_count / row_count * 100, 4) AS null_pct,
                     round((1 - distinct_count / row_count) * 100, 4) AS duplicate_pct FROM ({_all(rows)}))"""


def _customer_list(segment: str, action: str) -> str:
    return f"""SELECT customer_id, customer_type, region, annual_rev_band, sla_hours, recency_days, frequency_count,
        round(monetary_value, 2) AS monetary_value, recency_score, frequency_score, monetary_score, last_order_date,
        round(lifetime_revenue, 2) AS lifetime_revenue, lifetime_orders, scoring_date, '{action}' AS recommended_action
        FROM custdim JOIN scores USING (customer_id) WHERE active_flag AND current_rfm_segment = '{segment}'"""


def _mean(c: str, digits: int) -> str:
    return f"round(CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE) / count({c}), {digits})"


def _history() -> str:
    return f"""WITH run1 AS (SELECT * FROM ords WHERE order_date <= DATE '2000-06-30'), old AS ({rfm("run1")})
        SELECT customer_id, scoring_date, rfm_segment, false AS is_current_flag, TIMESTAMP '2000-07-01' AS valid_from,
               TIMESTAMP '2001-09-01' AS valid_to FROM old
        UNION ALL SELECT customer_id, scoring_date, rfm_segment, true, TIMESTAMP '2001-09-01', NULL FROM scores"""


FEATURE_KEYS = "SELECT sku_id, warehouse_id, feature_date, abc_class"
ORDER_COLUMNS = """order_id, customer_id, sku_id, order_date, ship_date, channel, ordered_qty, shipped_qty, revenue,
    on_time_flag, in_full_flag, otif_flag, days_to_ship"""
ERF = "1 / (1 + 0.3275911 * x)"
Z_TEST = f"""
    SELECT test_name, n_test, n_control, conversions_test, conversions_control, round(pt, 4) AS conversion_rate_test,
        round(pc, 4) AS conversion_rate_control, round(lift, 2) AS lift_pct, round(z, 4) AS z_statistic, round(p, 4) AS p_value,
        p < 0.05 AS significant, p < 0.05 AND lift > 0 AS deploy, round(pt - pc - 1.96 * sd, 4) AS ci_lower_95,
        round(pt - pc + 1.96 * sd, 4) AS ci_upper_95, round(abs(2 * asin(sqrt(pt)) - 2 * asin(sqrt(pc))), 4) AS cohens_h,
        CASE WHEN p < 0.05 AND lift > 0 THEN 'adopt' WHEN p < 0.05 THEN 'reject' ELSE 'undecided' END || ' for At Risk: '
            || printf('%+.1f', lift) || ' % conversions, p ' || printf('%.3f', p) AS recommendation
    FROM (SELECT *, (0.254829592 * t - 0.284496736 * t ** 2 + 1.421413741 * t ** 3 - 1.453152027 * t ** 4 + 1.061405429 * t ** 5)
                    * exp(-x * x) AS p
          FROM (SELECT *, {ERF} AS t FROM (SELECT *, abs(z) / sqrt(2) AS x FROM (
              SELECT *, CASE WHEN pool > 0 AND pool < 1 THEN (pt - pc) / sqrt(pool * (1 - pool) * (1 / n_test + 1 / n_control)) ELSE 0 END AS z,
                     sqrt(pt * (1 - pt) / n_test + pc * (1 - pc) / n_control) AS sd,
                     CASE WHEN pc > 0 THEN (pt - pc) / pc * 100 ELSE 0 END AS lift
              FROM (SELECT *, conversions_test / n_test AS pt, conversions_control / n_control AS pc,
                           (conversions_test + conversions_control) / (n_test + n_control) AS pool
                    FROM (SELECT test_name, count(*) FILTER (test_group = 'test') AS n_test,
                                 count(*) FILTER (test_group = 'control') AS n_control,
                                 count(*) FILTER (test_group = 'test' AND converted_flag) AS conversions_test,
                                 count(*) FILTER (test_group = 'control' AND converted_flag) AS conversions_control
                          FROM outcomes GROUP BY test_name))))))"""

_LAST = f"{LAST_SHIP} - 91", LAST_SHIP
_MODELS = {1: "rolling_avg_14", 2: "rolling_avg_28", 3: "lag_28"}

_QUERIES = {
    # star schema
    "dim_date": "SELECT * FROM star_dates",
    "dim_warehouse": "SELECT * FROM sites",
    "dim_supplier": "SELECT * FROM star_suppliers",
    "csv_suppliers": "SELECT *, 'suppliers.csv' AS etl_source_file FROM star_suppliers",
    "csv_champions": _customer_list("Champions", "Upsell / loyalty programme — premium tier invitation"),
    "run_log_latest": """SELECT CAST(2 AS BIGINT) AS run_id, 'lineitem' AS step, 'OK' AS status, count(*) AS rows_processed FROM lineitem
        UNION ALL SELECT 2, 'orders', 'OK', count(*) FROM orders""",
    "dim_sku": "SELECT * FROM star_skus",
    "fact_daily_demand": "SELECT * FROM star_demand",
    "fact_inventory_snapshot": "SELECT * FROM star_stock",
    "star_monthly_revenue": """SELECT year, month_num, s.abc_class, warehouse_id,
        round(CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE), 2) AS total_revenue,
        CAST(sum(quantity_demanded) AS BIGINT) AS units_demanded, count(*) AS demand_rows
        FROM star_demand JOIN star_dates USING (date_key) JOIN star_skus s USING (sku_key) JOIN sites USING (warehouse_key)
        GROUP BY ALL""",
    "top_stockout_items": """SELECT sku_id, category, s.abc_class, count(*) AS total_days,
        count(*) FILTER (stockout_flag) AS stockout_days,
        round(100.0 * count(*) FILTER (stockout_flag) / count(*), 2) AS stockout_rate_pct
        FROM star_demand JOIN star_skus s USING (sku_key) GROUP BY ALL HAVING stockout_days > 0
        ORDER BY stockout_rate_pct DESC, stockout_days DESC, sku_id LIMIT 20""",
    "monthly_inventory_accuracy": """SELECT year, month_num, warehouse_id,
        round(CAST(sum(CAST(inventory_record_accuracy AS DECIMAL(18,9))) AS DOUBLE) / count(inventory_record_accuracy) * 100, 2)
            AS avg_accuracy_pct,
        round(CAST(sum(CAST(inventory_value AS DECIMAL(18,4))) AS DOUBLE), 2) AS total_inventory_value, count(*) AS snapshot_rows
        FROM star_stock JOIN stock_dates USING (date_key) JOIN sites USING (warehouse_key) GROUP BY ALL""",
    "supplier_two_hop": """SELECT supplier_key, supplier_id, supplier_name, country, count(DISTINCT sku_key) AS skus,
        CAST(sum(quantity_demanded) AS BIGINT) AS units_demanded,
        round(100.0 * sum(quantity_fulfilled) / sum(quantity_demanded), 2) AS fill_rate_pct,
        round(CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE), 2) AS total_revenue
        FROM star_demand JOIN star_skus USING (sku_key) JOIN star_suppliers USING (supplier_id) GROUP BY ALL""",
    "column_profile": _profile(),
    "null_counts": "SELECT name AS \"column\", n AS null_count, round(n / total * 100, 2) AS null_pct FROM (UNPIVOT ("
    + "SELECT count(*) AS total, "
    + ", ".join(
        f"count(*) - count({c}) AS {c}"
        for c in """sku_key sku_id category abc_class xyz_class unit_cost unit_price weight_kg volume_cbm storage_type supplier_id
        lead_time_days min_order_qty safety_stock_qty reorder_point_qty primary_warehouse active_flag""".split()
    )
    + " FROM star_skus) ON COLUMNS(* EXCLUDE total) INTO NAME name VALUE n)",
    # forecasting
    "demand_features": f"SELECT {SIX_DIGITS} FROM series_features",
    "demand_features_calendar": f"SELECT {SIX_DIGITS} FROM ({FEATURE_KEYS}, {calendar('feature_date')}, {features('series', 'days')})",
    "demand_features_expanding": f"""SELECT {SIX_DIGITS} FROM (
        {FEATURE_KEYS}, {calendar('feature_date')}, {features('series', fill='expanding')})""",
    "star_features": f"""WITH demand AS (SELECT full_date AS feature_date, sku_id, warehouse_id, s.abc_class, s.xyz_class,
            quantity_demanded FROM star_demand JOIN star_dates USING (date_key) JOIN star_skus s USING (sku_key)
            JOIN sites USING (warehouse_key) WHERE s.active_flag)
        SELECT {SIX_DIGITS} FROM ({FEATURE_KEYS}, xyz_class, {calendar("feature_date")}, {features("demand")})""",
    "baseline_forecasts": "SELECT * FROM forecasts",
    "model_evaluation": "SELECT * FROM performance",
    "model_evaluation_by_site": evaluation("series", "series_features", *_LAST, _MODELS, "sku_id, warehouse_id"),
    "custom_model_evaluation": evaluation("series", "series_features", *_LAST, {4: "0.3 * lag_1 + 0.7 * rolling_avg_7"}),
    "error_by_class": "SELECT * FROM class_errors",
    "best_model_per_class": "SELECT * FROM best",
    "planner_forecast": """SELECT f.sku_id AS "SKU_ID", category AS "Category", i.abc_class AS "ABC_Class",
        warehouse_id AS "Warehouse_ID", primary_warehouse AS "Primary_Warehouse", forecast_date AS "Forecast_Date",
        forecasted_qty AS "Forecasted_Qty", lower_bound AS "Lower_Bound", upper_bound AS "Upper_Bound",
        ['moving_average_14d', 'moving_average_28d', 'seasonal_naive'][f.model_id] AS "Model_Used"
        FROM forecasts f JOIN series_items i ON f.sku_id = i.sku_id
        JOIN best b ON b.abc_class = i.abc_class AND b.model_id = f.model_id""",
    # customers
    "orders_clean": "SELECT * FROM first_orders WHERE customer_id IN (SELECT customer_id FROM cust)",
    "orders_rejected": """SELECT order_id, customer_id, sku_id, order_date FROM first_orders
        WHERE customer_id NOT IN (SELECT customer_id FROM cust)""",
    "orders_quarantine": """SELECT order_id, customer_id, sku_id, order_date, 'unknown customer' AS verdict FROM first_orders
        WHERE customer_id NOT IN (SELECT customer_id FROM cust)""",
    "fact_orders": f"SELECT {ORDER_COLUMNS} FROM ords",
    "customer_lifetime": f"""SELECT * EXCLUDE (current_rfm_segment) FROM ({customers_with("scores", "ords")})""",
    "rfm_scores": "SELECT * FROM scores",
    "rfm_scores_after_delta": "SELECT * FROM scores",
    "rfm_scores_strict": rfm("ords", strict=True),
    "rfm_segment_distribution": """SELECT rfm_segment AS segment, count(*) AS customer_count,
        round(100.0 * count(*) / (SELECT count(*) FROM scores), 2) AS pct_of_total, scoring_date FROM scores GROUP BY ALL""",
    "rfm_history": _history(),
    "rfm_at_date": f"""SELECT customer_id, scoring_date, rfm_segment, valid_from FROM ({_history()})
        WHERE valid_from <= TIMESTAMP '2000-12-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2000-12-01')""",
    "orders_with_score": f"""SELECT order_id, o.customer_id, order_date, rfm_segment, scoring_date FROM ords o
        LEFT JOIN ({_history()}) h ON h.customer_id = o.customer_id AND valid_from <= order_date AND (valid_to IS NULL OR valid_to > order_date)""",
    "customer_segments": """SELECT customer_id, customer_type, region, annual_rev_band, sla_hours, active_flag,
        current_rfm_segment AS rfm_segment, recency_days, frequency_count, round(monetary_value, 2) AS monetary_value,
        recency_score, frequency_score, monetary_score, scoring_date, last_order_date,
        round(lifetime_revenue, 2) AS lifetime_revenue, lifetime_orders
        FROM custdim LEFT JOIN scores USING (customer_id) WHERE active_flag""",
    "at_risk_customers": _customer_list("At Risk", "Re-engagement campaign — offer discount or account review"),
    "champion_customers": _customer_list("Champions", "Upsell / loyalty programme — premium tier invitation"),
    "segment_performance": f"""SELECT current_rfm_segment AS segment, count(*) AS customer_count,
        {_mean("lifetime_revenue", 2)} AS avg_lifetime_revenue,
        round(CAST(sum(CAST(lifetime_revenue AS DECIMAL(18,4))) AS DOUBLE), 2) AS total_segment_revenue,
        {_mean("lifetime_orders", 1)} AS avg_orders_per_customer, round(100.0 * sum(otif) / sum(n), 2) AS otif_rate_pct,
        {_mean("recency_days", 0)} AS avg_recency_days, {_mean("frequency_count", 1)} AS avg_frequency,
        {_mean("monetary_value", 2)} AS avg_monetary
        FROM custdim LEFT JOIN scores USING (customer_id)
        LEFT JOIN (SELECT customer_id, count(*) AS n, count(*) FILTER (otif_flag) AS otif FROM ords GROUP BY 1) USING (customer_id)
        WHERE active_flag AND current_rfm_segment IS NOT NULL GROUP BY ALL""",
    "ab_assignment": "SELECT * FROM assigned",
    "ab_assignment_with_history": """SELECT * FROM (
        WITH numbered AS (SELECT customer_id, CAST(substr(customer_id, 6, 12) AS BIGINT) AS k FROM cust),
        earlier AS (
            SELECT k * 2 AS assignment_id, customer_id, 'spring_trial' AS test_name, CASE WHEN k % 2 = 0 THEN 'test' ELSE 'control' END AS test_group,
                DATE '2000-02-01' AS assigned_at, DATE '2000-07-31' AS test_end_date FROM numbered WHERE k % 5 = 0
            UNION ALL
            SELECT k * 2 + 1, customer_id, 'summer_trial', CASE WHEN k % 2 = 0 THEN 'test' ELSE 'control' END,
                DATE '2000-06-15', DATE '2000-09-15' FROM numbered WHERE k % 3 = 0
        ), split AS (
            SELECT customer_id, CASE WHEN row_number() OVER (ORDER BY md5('42|winback_trial|' || customer_id), customer_id)
                <= floor(count(*) OVER () * 0.5) THEN 'test' ELSE 'control' END AS test_group
            FROM past_custdim WHERE current_rfm_segment = 'At Risk' AND active_flag
            AND customer_id NOT IN (SELECT customer_id FROM earlier WHERE test_name = 'summer_trial')
        )
        SELECT * FROM earlier
        UNION ALL
        SELECT row_number() OVER (ORDER BY test_group DESC, customer_id) + (SELECT max(assignment_id) FROM earlier), customer_id,
            'winback_trial', test_group, DATE '2000-08-01', DATE '2001-08-01' FROM split)""",
    "ab_outcomes": """SELECT assignment_id, customer_id, test_group, converted_flag, conversion_date, revenue_post_assignment,
        primary_metric_value FROM outcomes""",
    "ab_analysis": Z_TEST,
    # warehouse
    "wms_tasks": "SELECT * FROM loaded_tasks",
    "operator_dim": "SELECT * FROM staff",
    "daily_kpis": """SELECT warehouse_id, task_date, task_type, count(*) AS tasks_completed,
        round(100.0 * count(*) FILTER (accuracy_flag) / count(*), 2) AS accuracy_rate_pct,
        round(CAST(sum(CAST(duration_min AS DECIMAL(18,4))) AS DOUBLE) / count(duration_min), 2) AS avg_duration_min,
        CAST(sum(quantity) AS BIGINT) AS total_quantity
        FROM tasks WHERE task_date >= (SELECT d FROM last_task) - 30 GROUP BY ALL""",
    "operator_scorecard": """SELECT operator_surrogate_id, hire_date_cohort, t.warehouse_id, count(*) AS total_tasks,
        count(DISTINCT (task_date, shift)) AS shifts_worked,
        round(count(*) / count(DISTINCT (task_date, shift)), 1) AS tasks_per_shift,
        round(100.0 * count(*) FILTER (accuracy_flag) / count(*), 2) AS accuracy_rate_pct,
        count(*) FILTER (NOT accuracy_flag) AS error_count, count(DISTINCT task_type) AS task_types_performed
        FROM loaded_tasks t LEFT JOIN staff USING (operator_surrogate_id)
        WHERE date_trunc('month', task_date) = date_trunc('month', (SELECT d FROM last_task)) GROUP BY ALL""",
    "location_scd2": "SELECT * FROM location_history",
    "locations_at_date": """SELECT location_id, warehouse_id, zone, storage_type, active_flag, capacity_units FROM location_history
        WHERE valid_from <= TIMESTAMP '2024-01-02 12:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-02 12:00:00')""",
    "tasks_with_location": """SELECT task_id, task_date, 'LOC-' || substr(sku_id, 5, 12) AS location_id, zone, capacity_units, active_flag
        FROM tasks t LEFT JOIN location_history h ON h.location_id = 'LOC-' || substr(sku_id, 5, 12)
        AND valid_from <= task_date AND (valid_to IS NULL OR valid_to > task_date)""",
    "sku_velocity": velocity("tasks", "(SELECT d FROM last_task)"),
    "slotting_recommendations": "SELECT * FROM slot_history",
    "slotting_queue": """SELECT row_number() OVER (ORDER BY warehouse_id, sku_id) AS slotting_id, sku_id, warehouse_id,
        recommendation_date, prior_zone, recommended_zone, pick_count AS pick_frequency_at_recommendation,
        saved AS est_daily_minutes_saved, round(saved * 260, 1) AS est_annual_minutes_saved, 'pending' AS implementation_status
        FROM (SELECT *, (SELECT d FROM last_task) AS recommendation_date, round(pick_count * 4.0::DOUBLE / 90, 2) AS saved
              FROM all_moves WHERE recommended_zone IS NOT NULL)""",
    "realised_savings": """SELECT slotting_id, sku_id, warehouse_id, estimated_daily_minutes_saved, saved AS actual_minutes_saved_post,
        round(saved / nullif(estimated_daily_minutes_saved, 0) * 100, 1) AS realisation_pct
        FROM (SELECT slotting_id, h.sku_id, h.warehouse_id, estimated_daily_minutes_saved,
                     round(coalesce(CAST(sum(CAST(duration_min AS DECIMAL(18,4))) FILTER (task_date < recommendation_date) AS DOUBLE)
                                    / count(duration_min) FILTER (task_date < recommendation_date), 0)
                           - coalesce(CAST(sum(CAST(duration_min AS DECIMAL(18,4))) FILTER (task_date > implementation_date) AS DOUBLE)
                                      / count(duration_min) FILTER (task_date > implementation_date), 0), 4) AS saved
              FROM slot_history h LEFT JOIN (SELECT * FROM tasks WHERE task_type = 'Pick') t
                   ON t.sku_id = h.sku_id AND t.warehouse_id = h.warehouse_id
              WHERE implementation_status = 'implemented' GROUP BY ALL)""",
    "cooccurrence_lift": "SELECT * FROM pairs",
    "adjacency_top": """SELECT warehouse_id, sku_id_1, sku_id_2, co_occurrence_count, co_occurrence_window,
        round(lift_score, 3) AS lift_score, 'Store in adjacent bays to reduce pick path distance' AS recommendation
        FROM (SELECT * FROM pairs WHERE lift_score > 1.0
              QUALIFY row_number() OVER (PARTITION BY warehouse_id ORDER BY pairs.lift_score DESC, sku_id_1, sku_id_2) <= 50)""",
    # increments
    "incremental_demand": """SELECT full_date AS date, sku_id, warehouse_id, d.abc_class, d.xyz_class, quantity_demanded,
        quantity_fulfilled, quantity_unfulfilled, stockout_flag, revenue, fill_rate
        FROM star_demand d JOIN star_dates USING (date_key) JOIN star_skus USING (sku_key) JOIN sites USING (warehouse_key)""",
    "reconciled_demand": """SELECT full_date AS date, sku_id, warehouse_id, d.abc_class, d.xyz_class, quantity_demanded,
        quantity_fulfilled, quantity_unfulfilled, stockout_flag, revenue, fill_rate
        FROM star_demand d JOIN star_dates USING (date_key) JOIN star_skus USING (sku_key) JOIN sites USING (warehouse_key)""",
    "reconciled_days": """SELECT full_date AS day, count(*) FILTER (seen) AS rows_before, count(*) AS rows_after,
        CASE WHEN count(*) FILTER (seen) = 0 THEN 'new' ELSE 'mended' END AS verdict
        FROM (SELECT full_date, full_date <= DATE '2000-06-30' AND NOT (warehouse_id = 'EUROPE' AND day(full_date) = 15) AS seen
              FROM star_demand JOIN star_dates USING (date_key) JOIN sites USING (warehouse_key))
        GROUP BY full_date HAVING count(*) FILTER (seen) < count(*) OR (month(full_date) = 3 AND day(full_date) = 20)""",
    "incremental_orders": f"SELECT {ORDER_COLUMNS} FROM ords",
    "incremental_features": f"""WITH early AS (SELECT * FROM series WHERE feature_date <= DATE '2000-06-30'),
        a AS ({FEATURE_KEYS}, {calendar("feature_date")}, {features("early")}),
        b AS (SELECT * FROM series_features WHERE feature_date > DATE '2000-06-30')
        SELECT {SIX_DIGITS} FROM (SELECT * FROM a UNION ALL BY NAME SELECT * FROM b)""",
    "streamed_orders": "SELECT * REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders",
    "streamed_orders_by_bucket": "SELECT * REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders",
    "streamed_lines": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(l_shipdate AS DATE) AS day FROM lineitem",
    "metric_drift": DRIFT,
    # data checks
    "dq_star": _star_report(),
    "dq_demand_by_load": _demand_report(),
    "dq_features": _feature_report(),
    "dq_monitor": _run_report(),
    "dq_customers": _customer_report(),
    "dq_wms": _task_report(),
}

TWINS = {name: with_views(sql) for name, sql in _QUERIES.items()}
