"""Common table expressions over the test tables, and the helper that puts the needed ones in front of a query."""

from __future__ import annotations

import re


def ident(prefix: str, number: str) -> str:
    return f"'{prefix}-' || lpad(CAST({number} AS VARCHAR), 12, '0')"


def season(month: str) -> str:
    return f"""CASE WHEN {month} IN (3, 4, 5) THEN 'Spring' WHEN {month} IN (6, 7, 8) THEN 'Summer'
        WHEN {month} IN (9, 10, 11) THEN 'Autumn' ELSE 'Winter' END"""


def calendar(d: str) -> str:
    return f"""CAST(isodow({d}) - 1 AS INTEGER) AS day_of_week, CAST(weekofyear({d}) AS INTEGER) AS week_of_year,
        CAST(month({d}) AS INTEGER) AS month, CAST(quarter({d}) AS INTEGER) AS quarter, isodow({d}) > 5 AS is_weekend,
        {season(f"month({d})")} AS season"""


def dates_to(last: str) -> str:
    return f"""
    SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS full_date,
           CAST(isodow(d) AS INTEGER) AS day_of_week, dayname(d) AS day_name, CAST(day(d) AS INTEGER) AS day_of_month,
           CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
           CAST(month(d) AS INTEGER) AS month_num, monthname(d) AS month_name, CAST(quarter(d) AS INTEGER) AS quarter,
           CAST(year(d) AS INTEGER) AS year, isodow(d) >= 6 AS is_weekend, day(d) = 1 AS is_month_start,
           d = last_day(d) AS is_month_end, d = last_day(d) AND month(d) % 3 = 0 AS is_quarter_end,
           {season("month(d)")} AS season
    FROM (SELECT CAST(unnest(generate_series(
              (SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem), {last}, INTERVAL 1 DAY)) AS DATE) AS d)"""


FEATURES = [f"lag_{n}" for n in (1, 7, 14, 28)] + [f"rolling_avg_{n}" for n in (7, 14, 28)] + ["rolling_std_7", "rolling_std_14"]
SIX_DIGITS = "* REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + ")"


def features(source: str, frames: str = "rows", fill: str = "series") -> str:
    """Feature columns over a CTE with sku_id, warehouse_id, feature_date, abc_class and quantity_demanded."""
    part = "PARTITION BY sku_id, warehouse_id ORDER BY feature_date"
    y = "CAST(quantity_demanded AS DOUBLE)"

    def frame(n: int) -> str:
        if frames == "rows":
            return f"({part} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        return f"({part} RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)"

    def lag(n: int) -> str:
        if frames == "rows":
            return f"lag({y}, {n}) OVER ({part})"
        return f"max({y}) OVER ({part} RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND INTERVAL {n} DAYS PRECEDING)"

    mean = f"avg({y}) OVER (PARTITION BY sku_id, warehouse_id)"
    if fill == "expanding":
        mean = f"avg({y}) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    columns = [f"coalesce({lag(n)}, {mean}) AS lag_{n}" for n in (1, 7, 14, 28)]
    columns += [f"coalesce(avg({y}) OVER {frame(n)}, {mean}) AS rolling_avg_{n}" for n in (7, 14, 28)]
    columns += [f"coalesce(stddev_samp({y}) OVER {frame(n)}, 0.0) AS rolling_std_{n}" for n in (7, 14)]
    return ", ".join(columns) + f" FROM {source}"


def rfm(orders: str, strict: bool = False) -> str:
    """Scores and segments from a CTE with customer_id, order_date and revenue."""
    metrics = {"recency_days": True, "frequency_count": False, "monetary_value": False}
    edges, scores = [], []
    for m, reverse in metrics.items():
        x = f"CAST({m} AS DOUBLE)"
        e = [f"round(quantile_cont({x}, {k / 5}), 9)" for k in range(1, 5)]
        edges.append(f"[{', '.join(e)}] AS e_{m}")
        edges.append(f"len(list_distinct([min({x}), {', '.join(e)}, max({x})])) = 6 AS ok_{m}")
        above = " + ".join(f"CAST({x} > e_{m}[{k}] AS INTEGER)" for k in range(1, 5))
        p = f"1 - p_{m}" if reverse else f"p_{m}"
        by_rank = " + ".join(f"CAST({p} > {k / 5} AS INTEGER)" for k in range(1, 5))
        name = m.split("_")[0]
        scores.append(
            f"CAST(CASE WHEN ok_{m} THEN {'5 - (' if reverse else '1 + ('}{above}) ELSE 1 + {by_rank} END AS INTEGER) AS {name}_score"
        )
    ranks = [
        f"(rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0) / count(*) OVER () AS p_{m}"
        for m in metrics
    ]
    at_risk = "WHEN r <= 2 AND f >= 3 AND m >= 3 THEN 'At Risk'"
    cannot_lose = "WHEN r <= 2 AND f >= 4 AND m >= 4 THEN 'Can''t Lose Them'"
    pair = f"{cannot_lose} {at_risk}" if strict else f"{at_risk} {cannot_lose}"
    return f"""
    SELECT customer_id, scoring_date, recency_days, frequency_count, monetary_value, r AS recency_score,
           f AS frequency_score, m AS monetary_score,
           CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Champions' WHEN r >= 3 AND f >= 3 AND m >= 3 THEN 'Loyal Customers'
                WHEN r >= 4 AND f <= 2 THEN 'New Customers' WHEN r >= 3 AND f >= 1 AND m >= 2 THEN 'Potential Loyalists'
                {pair} WHEN r = 1 AND f = 1 THEN 'Lost' WHEN r <= 2 AND f <= 2 AND m <= 2 THEN 'Hibernating'
                WHEN r >= 2 AND m >= 3 THEN 'Promising' ELSE 'Need Attention' END AS rfm_segment
    FROM (SELECT *, recency_score AS r, frequency_score AS f, monetary_score AS m FROM (
        SELECT *, {", ".join(scores)} FROM (
            SELECT *, {", ".join(ranks)} FROM (
                SELECT customer_id, (SELECT max(order_date) FROM {orders}) AS scoring_date,
                       CAST((SELECT max(order_date) FROM {orders}) - max(order_date) AS INTEGER) AS recency_days,
                       count(*) AS frequency_count, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS monetary_value
                FROM {orders} GROUP BY customer_id)) base,
            (SELECT {", ".join(edges)} FROM (
                SELECT (SELECT max(order_date) FROM {orders}) - max(order_date) AS recency_days,
                       count(*) AS frequency_count, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS monetary_value
                FROM {orders} GROUP BY customer_id))))"""


def customers_with(scores: str, orders: str) -> str:
    """Customer dimension with lifetime metrics and segment."""
    return f"""
    SELECT c.customer_id, customer_type, region, sla_hours, annual_rev_band, active_flag, contract_since,
           s.rfm_segment AS current_rfm_segment, first_order_date, last_order_date,
           coalesce(lifetime_orders, 0) AS lifetime_orders, coalesce(lifetime_revenue, 0.0) AS lifetime_revenue
    FROM cust c
    LEFT JOIN (SELECT customer_id, min(order_date) AS first_order_date, max(order_date) AS last_order_date,
                      count(*) AS lifetime_orders, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS lifetime_revenue
               FROM {orders} GROUP BY customer_id) m ON c.customer_id = m.customer_id
    LEFT JOIN {scores} s ON c.customer_id = s.customer_id"""


def evaluation(source: str, feats: str, first: str, last: str, models: dict[int, str], keys: str = "sku_id") -> str:
    rows = " UNION ALL ".join(
        f"""SELECT a.sku_id, a.warehouse_id, a.abc_class, CAST({i} AS INTEGER) AS model_id,
            {m} - a.quantity_demanded AS err, a.quantity_demanded AS actual
        FROM {source} a JOIN {feats} f USING (sku_id, warehouse_id, feature_date)
        WHERE feature_date BETWEEN {first} AND {last}"""
        for i, m in models.items()
    )
    return f"""
    SELECT model_id, {keys}, min(abc_class) AS abc_class,
           round(100 * avg(CASE WHEN actual > 0 THEN abs(err) / actual END), 6) AS mape,
           round(sqrt(avg(err * err)), 6) AS rmse, round(avg(abs(err)), 6) AS mae, round(avg(err), 6) AS bias
    FROM ({rows}) GROUP BY model_id, {keys}"""


def location_batch(n: int) -> str:
    moved = f"CASE WHEN {n} >= 2 AND p_partkey % 10 = 0 THEN 1 ELSE 0 END"
    return f"""
    SELECT {n} AS batch, {ident("LOC", "p_partkey")} AS location_id, 'WH-' || CAST(p_partkey % 3 AS VARCHAR) AS warehouse_id,
           ['Bulk', 'Pick_Face', 'Reserve'][(length(p_type) + {moved}) % 3 + 1] AS zone,
           'A' || CAST(p_partkey % 20 AS VARCHAR) AS aisle, CAST(p_partkey % 50 AS INTEGER) AS bay,
           CAST(p_size % 5 AS INTEGER) AS level,
           CAST(p_size * 10 + CASE WHEN {n} >= 2 AND p_partkey % 7 = 0 THEN 5 ELSE 0 END AS INTEGER) AS capacity_units,
           CASE WHEN {BRAND_NUMBER} % 2 = 0 THEN 'Ambient' ELSE 'Bulk' END AS storage_type,
           (p_size <= 45) <> ({n} >= 3 AND p_partkey % 15 = 0) AS active_flag
    FROM part WHERE {n} >= 3 OR p_size <= 46"""


def recommendations(tasks: str, last_day: str, lookback: int = 90) -> str:
    """Misplaced items with velocity, as of a set of tasks."""
    return f"""
    SELECT f.*, zones, CASE WHEN velocity_class = 'Hot' AND prior_zone <> 'Pick_Face' THEN 'Pick_Face'
                            WHEN velocity_class = 'Cold' AND prior_zone = 'Pick_Face' THEN 'Reserve' END AS recommended_zone
    FROM (SELECT v.*, zones,
                 CASE WHEN zones IS NULL THEN 'Reserve' ELSE
                     zones[CAST('0x' || substr(md5(sku_id || v.warehouse_id), 1, 7) AS BIGINT) % len(zones) + 1] END AS prior_zone
          FROM ({velocity(tasks, last_day, lookback)}) v
          LEFT JOIN (SELECT warehouse_id, list_sort(list(DISTINCT zone)) AS zones FROM location_history
                     WHERE is_current GROUP BY warehouse_id) z ON v.warehouse_id = z.warehouse_id) f"""


def velocity(tasks: str, last_day: str, lookback: int = 90) -> str:
    return f"""
    SELECT warehouse_id, sku_id, pick_count,
           CASE WHEN pct >= 0.9 THEN 'Hot' WHEN pct >= 0.7 THEN 'Warm' WHEN pct >= 0.4 THEN 'Cool' ELSE 'Cold' END AS velocity_class
    FROM (SELECT *, (rank() OVER (PARTITION BY warehouse_id ORDER BY pick_count)
                     + (count(*) OVER (PARTITION BY warehouse_id, pick_count) - 1) / 2.0)
                    / count(*) OVER (PARTITION BY warehouse_id) AS pct
          FROM (SELECT warehouse_id, sku_id, count(*) AS pick_count FROM {tasks}
                WHERE task_type = 'Pick' AND task_date >= {last_day} - {lookback} GROUP BY ALL))"""


BRAND_NUMBER = "CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER)"
LAST_SHIP = "(SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem)"
CLASS_OF_SIZE = "CASE WHEN p_size <= 16 THEN 'A' WHEN p_size <= 33 THEN 'B' ELSE 'C' END"
CLASS_OF_BRAND = f"CASE {BRAND_NUMBER} % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END"

VIEWS = {
    "sites": """SELECT row_number() OVER (ORDER BY r_name) AS warehouse_key, r_name AS warehouse_id,
        'Warehouse ' || r_name AS warehouse_name, r_name AS region, true AS active_flag FROM region""",
    "supplier_site": """SELECT s_suppkey, r_name AS warehouse_id FROM supplier
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ship_lines": """SELECT CAST(l_shipdate AS DATE) AS ship_date, lineitem.*, warehouse_id
        FROM lineitem JOIN supplier_site ON l_suppkey = s_suppkey""",
    "star_dates": dates_to(LAST_SHIP),
    "stock_dates": dates_to(f"last_day({LAST_SHIP})"),
    "star_suppliers": f"""SELECT row_number() OVER (ORDER BY s_suppkey) AS supplier_key, {ident("SUP", "s_suppkey")} AS supplier_id,
        s_name AS supplier_name, n_name AS country, r_name AS category_focus,
        CAST(s_suppkey % 12 + 3 AS DOUBLE) AS lead_time_avg_days, (s_suppkey % 5) / 2.0 AS lead_time_std_days,
        CASE WHEN s_suppkey % 10 <> 0 THEN CAST((s_suppkey % 20 + 80) / 100 AS DOUBLE) END AS otif_rate,
        CAST((s_suppkey % 10 + 90) / 100 AS DOUBLE) AS fill_rate, CAST((s_suppkey % 4) / 100 AS DOUBLE) AS defect_rate,
        s_acctbal >= 0 AS active_flag
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "star_skus": f"""SELECT row_number() OVER (ORDER BY p_partkey) AS sku_key, {ident("SKU", "p_partkey")} AS sku_id,
        p_type AS category, {CLASS_OF_SIZE} AS abc_class, CAST(NULL AS VARCHAR) AS xyz_class,
        p_retailprice / 2 AS unit_cost, p_retailprice AS unit_price, CAST(p_size / 4 AS DOUBLE) AS weight_kg,
        CASE WHEN p_size <> 50 THEN CAST(p_size / 8 AS DOUBLE) END AS volume_cbm,
        ['Ambient', 'Bulk', 'Controlled', 'Hazmat'][{BRAND_NUMBER} % 4 + 1] AS storage_type,
        {ident("SUP", "p_partkey % (SELECT count(*) FROM supplier)")} AS supplier_id,
        CASE WHEN p_size <> 1 THEN CAST(p_size % 30 AS BIGINT) END AS lead_time_days,
        CAST(p_size * 10 AS BIGINT) AS min_order_qty, CAST(p_size * 3 AS BIGINT) AS safety_stock_qty,
        CAST(p_size * 5 AS BIGINT) AS reorder_point_qty, r_name AS primary_warehouse, p_size <= 40 AS active_flag
        FROM part LEFT JOIN region ON p_partkey % 5 = r_regionkey""",
    "star_demand": f"""SELECT row_number() OVER (ORDER BY date_key, sku_key, warehouse_key) AS demand_key, date_key, sku_key,
        warehouse_key, g.abc_class, g.xyz_class, quantity_demanded, quantity_fulfilled,
        greatest(quantity_demanded - quantity_fulfilled, 0) AS quantity_unfulfilled,
        quantity_fulfilled < quantity_demanded AS stockout_flag,
        CASE WHEN quantity_fulfilled > 0 THEN CAST(revenue AS DOUBLE) ELSE 0.0 END AS revenue,
        CASE WHEN quantity_demanded > 0 THEN CAST(quantity_fulfilled AS DOUBLE) / quantity_demanded END AS fill_rate
        FROM (SELECT ship_date, p_partkey, warehouse_id, {CLASS_OF_SIZE} AS abc_class,
                     ['X', 'Y', 'Z'][p_size % 3 + 1] AS xyz_class,
                     CAST(sum(l_quantity) AS BIGINT) AS quantity_demanded,
                     CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS quantity_fulfilled,
                     sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS revenue
              FROM ship_lines JOIN part ON l_partkey = p_partkey GROUP BY ALL) g
        LEFT JOIN star_dates ON ship_date = full_date
        LEFT JOIN star_skus ON {ident("SKU", "p_partkey")} = sku_id
        LEFT JOIN sites USING (warehouse_id)""",
    "star_stock": f"""SELECT row_number() OVER (ORDER BY date_key, sku_key, warehouse_key) AS snapshot_key, date_key, sku_key,
        warehouse_key, on_hand_qty, in_transit_qty, committed_qty, on_hand_qty - committed_qty AS available_qty,
        CAST(value AS DOUBLE) AS inventory_value,
        CASE WHEN on_hand_qty > 0 THEN CAST(on_hand_qty - committed_qty AS DOUBLE) / on_hand_qty END AS inventory_record_accuracy
        FROM (SELECT last_day(ship_date) AS day, p_partkey, warehouse_id, CAST(sum(l_quantity) AS BIGINT) AS on_hand_qty,
                     CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS BIGINT) AS committed_qty,
                     CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS in_transit_qty,
                     sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS value
              FROM ship_lines JOIN part ON l_partkey = p_partkey GROUP BY ALL) g
        LEFT JOIN stock_dates ON day = full_date
        LEFT JOIN star_skus ON {ident("SKU", "p_partkey")} = sku_id
        LEFT JOIN sites USING (warehouse_id)""",
    "series": f"""SELECT ship_date AS feature_date, p_brand AS sku_id, warehouse_id, {CLASS_OF_BRAND} AS abc_class,
        CAST(sum(l_quantity) AS BIGINT) AS quantity_demanded
        FROM ship_lines JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "series_items": f"""SELECT DISTINCT p_brand AS sku_id, 'Category ' || CAST({BRAND_NUMBER} % 4 AS VARCHAR) AS category,
        {CLASS_OF_BRAND} AS abc_class, r_name AS primary_warehouse, true AS active_flag
        FROM part LEFT JOIN region ON {BRAND_NUMBER} % 5 = r_regionkey""",
    "series_features": f"SELECT sku_id, warehouse_id, feature_date, abc_class, {calendar('feature_date')}, {features('series')}",
    "performance": evaluation(
        "series", "series_features", f"{LAST_SHIP} - 91", LAST_SHIP, {1: "rolling_avg_14", 2: "rolling_avg_28", 3: "lag_28"}
    ),
    "class_errors": """SELECT abc_class, model_id,
        round(CAST(sum(CAST(mape AS DECIMAL(18,6))) AS DOUBLE) / count(mape), 6) AS avg_mape
        FROM performance WHERE mape IS NOT NULL GROUP BY ALL""",
    "best": """SELECT c.abc_class, coalesce(model_id, CAST(1 AS INTEGER)) AS model_id, avg_mape
        FROM (SELECT DISTINCT abc_class FROM series_items) c
        LEFT JOIN (SELECT * FROM class_errors
                   QUALIFY row_number() OVER (PARTITION BY abc_class ORDER BY avg_mape, model_id) = 1) b USING (abc_class)""",
    "basis": f"""SELECT *, row_number() OVER (PARTITION BY sku_id, warehouse_id ORDER BY feature_date DESC) AS nth
        FROM series WHERE feature_date >= {LAST_SHIP} - 179""",
    "tails": """SELECT sku_id, warehouse_id, avg(quantity_demanded) FILTER (nth <= 14) AS m14,
        avg(quantity_demanded) FILTER (nth <= 28) AS m28,
        coalesce(max(quantity_demanded) FILTER (nth = 28), avg(quantity_demanded) FILTER (nth <= 14)) AS naive,
        CASE WHEN count(*) >= 2 THEN stddev_pop(quantity_demanded) FILTER (nth <= 14)
             ELSE greatest(0.2 * avg(quantity_demanded) FILTER (nth <= 14), 1.0) END AS spread
        FROM basis GROUP BY ALL""",
    "forecasts": f"""SELECT sku_id, warehouse_id, model_id, {LAST_SHIP} + CAST(h AS INTEGER) AS forecast_date,
        CAST(h AS INTEGER) AS forecast_horizon_days, round(p, 4) AS forecasted_qty,
        greatest(0.0, round(p - 1.282 * spread, 4)) AS lower_bound, round(p + 1.282 * spread, 4) AS upper_bound,
        CAST(0.8 AS DOUBLE) AS confidence_level
        FROM (SELECT sku_id, warehouse_id, spread, CAST(1 AS INTEGER) AS model_id, m14 AS p FROM tails UNION ALL
              SELECT sku_id, warehouse_id, spread, 2, m28 FROM tails UNION ALL
              SELECT sku_id, warehouse_id, spread, 3, naive FROM tails), range(1, 31) r(h)""",
    "cust": f"""SELECT {ident("CUST", "c_custkey")} AS customer_id, c_mktsegment AS customer_type, r_name AS region,
        CAST(24 * (1 + n_nationkey % 4) AS INTEGER) AS sla_hours,
        CASE WHEN c_acctbal < 0 THEN '<0' WHEN c_acctbal < 2500 THEN '0-2500' WHEN c_acctbal < 5000 THEN '2500-5000'
             ELSE '>=5000' END AS annual_rev_band,
        c_acctbal >= 0 AS active_flag, CAST(DATE '1995-01-01' - n_nationkey AS DATE) AS contract_since
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ords": f"""SELECT order_id, customer_id, sku_id, order_date, ship_date, channel, ordered_qty, shipped_qty, revenue,
        on_time_flag, in_full_flag, on_time_flag AND in_full_flag AS otif_flag,
        CASE WHEN ship_date - order_date < 0 THEN 0 ELSE CAST(ship_date - order_date AS INTEGER) END AS days_to_ship
        FROM (SELECT {ident("ORD", "o_orderkey")} AS order_id, {ident("CUST", "o_custkey")} AS customer_id,
                     {ident("SKU", "part")} AS sku_id, CAST(o_orderdate AS DATE) AS order_date, ship AS ship_date,
                     o_orderpriority AS channel, coalesce(ordered, 0) AS ordered_qty, coalesce(shipped, 0) AS shipped_qty,
                     o_totalprice AS revenue, coalesce(ship <= CAST(o_orderdate AS DATE) + 30, false) AS on_time_flag,
                     coalesce(ordered = shipped, false) AS in_full_flag
              FROM orders LEFT JOIN (
                  SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS ship, CAST(sum(l_quantity) AS BIGINT) AS ordered,
                         CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS shipped,
                         min(l_partkey) AS part
                  FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)""",
    "repeated_orders": f"""SELECT {ident("ORD", "l_orderkey")} || '-' || CAST(l_linenumber AS VARCHAR) AS order_id,
        CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS ship_date, {ident("SKU", "l_partkey")} AS sku_id,
        CASE WHEN l_partkey % 97 = 0 THEN 'CUST-?' ELSE {ident("CUST", "o_custkey")} END AS customer_id,
        {ident("SUP", "l_suppkey")} AS warehouse_id, o_orderpriority AS channel, CAST(l_quantity AS BIGINT) AS ordered_qty,
        CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS shipped_qty, l_extendedprice AS revenue,
        l_shipdate <= o_orderdate + INTERVAL 30 DAY AS on_time_flag, l_returnflag <> 'R' AS in_full_flag,
        l_shipdate <= o_orderdate + INTERVAL 30 DAY AND l_returnflag <> 'R' AS otif_flag,
        CAST(greatest(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE), 0) AS INTEGER) AS days_to_ship
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "first_orders": """SELECT * FROM repeated_orders QUALIFY row_number() OVER (PARTITION BY order_id
        ORDER BY ship_date, sku_id, warehouse_id, revenue) = 1""",
    "scores": rfm("ords"),
    "custdim": customers_with("scores", "ords"),
    "past_orders": "SELECT * FROM ords WHERE order_date <= DATE '2000-08-01'",
    "past_scores": rfm("past_orders"),
    "past_custdim": customers_with("past_scores", "past_orders"),
    "assigned": """SELECT row_number() OVER (ORDER BY test_group DESC, customer_id) AS assignment_id, customer_id,
        'winback_trial' AS test_name, test_group, DATE '2000-08-01' AS assigned_at, DATE '2001-08-01' AS test_end_date
        FROM (SELECT customer_id, CASE WHEN row_number() OVER (
                  ORDER BY md5('42|winback_trial|' || customer_id), customer_id)
                  <= floor(count(*) OVER () * 0.5) THEN 'test' ELSE 'control' END AS test_group
              FROM past_custdim WHERE current_rfm_segment = 'At Risk' AND active_flag)""",
    "outcomes": """SELECT a.*, first_order IS NOT NULL AS converted_flag, first_order AS conversion_date,
        coalesce(total, 0.0) AS revenue_post_assignment, coalesce(total, 0.0) AS primary_metric_value
        FROM assigned a LEFT JOIN (
            SELECT assignment_id, min(order_date) AS first_order, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS total
            FROM assigned JOIN ords USING (customer_id)
            WHERE order_date > assigned_at AND order_date <= test_end_date GROUP BY 1) USING (assignment_id)""",
    "tasks": f"""SELECT {ident("TASK", "event_id")} AS task_id, {ident("SKU", "k")} AS sku_id,
        'WH-' || CAST(user_id % 3 AS VARCHAR) AS warehouse_id,
        'OP-' || upper(substr(sha256({ident("EMP", "user_id")}), 1, 8)) AS operator_id, CAST(ts AS DATE) AS task_date,
        CASE WHEN event_type = 'click' THEN 'Pick' ELSE upper(event_type[1]) || event_type[2:] END AS task_type,
        CASE WHEN hour(ts) < 8 THEN 'Night' WHEN hour(ts) < 16 THEN 'Morning' ELSE 'Afternoon' END AS shift,
        value AS duration_min, CAST(1 + k % 10 AS BIGINT) AS quantity, k % 20 <> 0 AS accuracy_flag,
        CASE WHEN k % 20 = 0 THEN 'E' || CAST(k % 5 AS VARCHAR) END AS error_code
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "staff": """SELECT row_number() OVER (ORDER BY operator_id) AS operator_surrogate_id, * FROM (
        SELECT operator_id, arg_min(warehouse_id, (task_date, warehouse_id)) AS warehouse_id,
               CAST(year(min(task_date)) AS VARCHAR) || '-Q' || CAST(quarter(min(task_date)) AS VARCHAR) AS hire_date_cohort,
               true AS active_flag FROM tasks GROUP BY operator_id)""",
    "loaded_tasks": """SELECT t.* EXCLUDE (operator_id), CAST(NULL AS VARCHAR) AS location_id, operator_surrogate_id
        FROM tasks t JOIN staff USING (operator_id)""",
    "last_task": "SELECT max(task_date) AS d FROM tasks",
    "location_deliveries": " UNION ALL ".join(location_batch(n) for n in (1, 2, 3)),
    "location_history": """SELECT row_number() OVER (ORDER BY batch, location_id) AS location_surrogate_id, location_id,
        warehouse_id, zone, aisle, bay, level, capacity_units, storage_type, active_flag,
        CAST(DATE '2023-12-31' + batch AS TIMESTAMP) AS valid_from,
        CAST(DATE '2023-12-31' + lead(batch) OVER (PARTITION BY location_id ORDER BY batch) AS TIMESTAMP) AS valid_to,
        lead(batch) OVER (PARTITION BY location_id ORDER BY batch) IS NULL AS is_current
        FROM (SELECT * FROM location_deliveries
              WINDOW w AS (PARTITION BY location_id ORDER BY batch)
              QUALIFY lag(batch) OVER w IS NULL OR lag(zone) OVER w <> zone OR lag(storage_type) OVER w <> storage_type
                      OR lag(active_flag) OVER w <> active_flag)""",
    "all_moves": recommendations("tasks", "(SELECT d FROM last_task)"),
    "early_tasks": "SELECT * FROM tasks WHERE task_date <= DATE '2024-01-15'",
    "first_run": f"""SELECT row_number() OVER (ORDER BY warehouse_id, sku_id) AS slotting_id, *
        FROM ({recommendations("early_tasks", "(SELECT max(task_date) FROM early_tasks)")}) WHERE recommended_zone IS NOT NULL""",
    "decided": """SELECT slotting_id, sku_id, warehouse_id, (SELECT max(task_date) FROM early_tasks) AS recommendation_date,
        prior_zone, recommended_zone, pick_count,
        CASE warehouse_id WHEN 'WH-0' THEN 'implemented' WHEN 'WH-1' THEN 'rejected' ELSE 'pending' END AS implementation_status,
        CASE WHEN warehouse_id = 'WH-0' THEN DATE '2024-01-16' END AS implementation_date FROM first_run""",
    "second_run": f"""SELECT row_number() OVER (ORDER BY warehouse_id, sku_id) + (SELECT max(slotting_id) FROM decided) AS slotting_id,
        sku_id, warehouse_id, (SELECT d FROM last_task) AS recommendation_date, prior_zone, recommended_zone, pick_count,
        'pending' AS implementation_status, CAST(NULL AS DATE) AS implementation_date
        FROM ({recommendations("tasks", "(SELECT d FROM last_task)")}) m
        WHERE recommended_zone IS NOT NULL AND NOT EXISTS (SELECT 1 FROM decided d WHERE d.implementation_status = 'pending'
              AND d.sku_id = m.sku_id AND d.warehouse_id = m.warehouse_id)""",
    "slot_history": """SELECT slotting_id, sku_id, warehouse_id, recommendation_date, prior_zone, recommended_zone,
        pick_count AS pick_frequency_at_recommendation, round(pick_count * 4.0::DOUBLE / 90, 2) AS estimated_daily_minutes_saved,
        implementation_status, implementation_date, CAST(NULL AS DOUBLE) AS actual_minutes_saved_post
        FROM (SELECT * FROM decided UNION ALL SELECT * FROM second_run)""",
    "session_items": """SELECT DISTINCT warehouse_id, task_date, shift, sku_id FROM tasks WHERE task_type = 'Pick'
        QUALIFY count(DISTINCT sku_id) OVER (PARTITION BY warehouse_id, task_date, shift) >= 2""",
    "support": "SELECT warehouse_id, sku_id, count(*) AS c FROM session_items GROUP BY ALL",
    "session_count": "SELECT warehouse_id, count(DISTINCT (task_date, shift)) AS n FROM session_items GROUP BY ALL",
    "pairs": """SELECT sku_id_1, sku_id_2, warehouse_id, co_occurrence_count, 'shift' AS co_occurrence_window, lift_score
        FROM (SELECT p.*, round(CAST(co_occurrence_count * n AS DOUBLE) / (a.c * b.c), 4) AS lift_score
              FROM (SELECT warehouse_id, x.sku_id AS sku_id_1, y.sku_id AS sku_id_2, count(*) AS co_occurrence_count
                    FROM session_items x JOIN session_items y USING (warehouse_id, task_date, shift)
                    WHERE x.sku_id < y.sku_id GROUP BY ALL) p
              JOIN support a ON a.warehouse_id = p.warehouse_id AND a.sku_id = sku_id_1
              JOIN support b ON b.warehouse_id = p.warehouse_id AND b.sku_id = sku_id_2
              JOIN session_count s ON s.warehouse_id = p.warehouse_id
              WHERE co_occurrence_count * n > a.c * b.c)
        QUALIFY row_number() OVER (PARTITION BY warehouse_id ORDER BY lift_score DESC, sku_id_1, sku_id_2) <= 200""",
}

for _run in (1, 2, 3):  # three forecast runs, each a year later
    _end = f"CAST({LAST_SHIP} - INTERVAL {12 * (3 - _run)} MONTH AS DATE)"
    VIEWS[f"known_{_run}"] = f"SELECT * FROM series WHERE feature_date <= {_end}"
    VIEWS[f"features_{_run}"] = f"SELECT sku_id, warehouse_id, feature_date, {features(f'known_{_run}')}"
    VIEWS[f"errors_{_run}"] = evaluation(
        f"known_{_run}", f"features_{_run}", f"{_end} - 91", _end, {1: "rolling_avg_14", 2: "rolling_avg_28", 3: "lag_28"}
    )
VIEWS["metric_history"] = " UNION ALL ".join(
    f"""SELECT CAST({r} AS BIGINT) AS run_id, CAST(sum(CAST(mape AS DECIMAL(18,6))) AS DOUBLE) / count(mape) AS avg_mape,
        count(*) AS n_evaluations, (SELECT count(*) FROM known_{r}) AS feature_rows FROM errors_{r}"""
    for r in (1, 2, 3)
)

_NAMES = re.compile(r"\b(" + "|".join(VIEWS) + r")\b")


def with_views(sql: str) -> str:
    """Put the definitions of all views a query mentions in front of it, in dependency order."""
    ordered: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAMES.findall(text)):
            if name not in ordered and name not in open_names:
                open_names.add(name)
                visit(VIEWS[name])
                ordered.append(name)

    visit(sql)
    definitions = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in ordered]
    if sql.startswith("WITH "):  # the query has its own definitions
        return "WITH " + ",\n".join([*definitions, sql.removeprefix("WITH ")])
    return "WITH " + ",\n".join(definitions) + "\n" + sql if definitions else sql
