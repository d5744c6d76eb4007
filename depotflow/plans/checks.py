"""The 49 data checks in five reports: star schema, feature store, forecast run, customers, warehouse tasks.

Row rules of one table share one pass; the result rows have the columns check, status, rows_checked, rows_failed, detail.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from depotflow.functions.numbers import rounded
from depotflow.operators.bitmaps import key_state, repeated_keys, with_membership
from depotflow.operators.quality import (
    PASSING_STATUSES,
    RowRule,
    as_rows,
    check_row,
    duplicated_groups,
    grouped,
    report,
    rule_counts,
    rule_rows,
    run_row_rules,
    same_row_count,
    sentence,
    summed_counts,
    surplus_rows,
    text,
    with_failure_pct,
    with_reference_flags,
)
from depotflow.session import stage

# Thresholds of the checks.
LAG_MISMATCH_PCT = 5.0
ROW_COUNT_TOLERANCE = 0.20
MAPE_DRIFT = 0.20
CHAMPION_MAX_PCT = 15.0
DURATION_MAX_MINUTES = 120
PICKS_PER_DAY = (50, 500)
OUTLIER_DEVIATIONS = 3.0
CALENDAR_COLUMNS = ["day_of_week", "week_of_year", "month", "quarter", "is_weekend", "season"]

FACTS = {"fact_daily_demand": "demand_key", "fact_inventory_snapshot": "snapshot_key"}
DIMENSIONS = {"dim_date": "date_key", "dim_warehouse": "warehouse_key", "dim_supplier": "supplier_key", "dim_sku": "sku_key"}
FOREIGN_KEYS = {"date_key": "dim_date", "sku_key": "dim_sku", "warehouse_key": "dim_warehouse"}
NOT_NEGATIVE = {
    "fact_daily_demand": ["quantity_demanded", "quantity_fulfilled"],
    "fact_inventory_snapshot": ["on_hand_qty", "available_qty"],
}


def star_checks(tables: dict[str, DataFrame], sources: dict[str, DataFrame], first: date, last: date) -> DataFrame:
    """26 checks: keys, references, duplicates, date range, signs, stock-out logic and completeness.

    One pass over each table gives its state: for each 32,768 neighbouring keys the bitmap of those present and the counts of
    all rules. References are bits of the dimensions' states, so no check shuffles a fact by key. A fact is read
    again, for repeated keys, only where a stretch of keys has more rows than keys.
    """
    states = {table: stage(key_state(tables[table], key)) for table, key in DIMENSIONS.items()}
    parts = []
    for table, key in DIMENSIONS.items():
        total, missing = F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("rows"))), F.lit(0))
        counts = states[table].agg(total.alias("c0"), missing.alias("f0"))
        parts.append(rule_rows(counts, [RowRule(f"null_pk_{table}", F.lit(None), text(f"{table}.{key}"))]))
        parts.append(duplicate_check(table, key, tables[table], states[table]))
    for table in FACTS:
        state = stage(fact_state(table, tables[table], states, tables["dim_date"], first, last))
        parts.append(fact_report(table, state, sources[table], first, last))
    return with_failure_pct(report(parts))


def fact_rules(table: str, first: date, last: date) -> list[RowRule]:
    """Rules on the rows of a fact with `_found_<key>` and `_outside` flags."""
    key = FACTS[table]
    rules = [RowRule(f"null_pk_{table}", F.col(key).isNull(), text(f"{table}.{key}"))]
    rules += [
        RowRule(f"ri_{table}_{c}", F.col(c).isNotNull() & ~F.col(f"_found_{c}"), text(f"{c} in {d}")) for c, d in FOREIGN_KEYS.items()
    ]
    rules.append(RowRule(f"date_range_{table}", F.col("_outside"), text(f"{first} .. {last}")))
    rules += [RowRule(f"qty_non_negative_{table}_{c}", F.col(c) < 0, text(f"{table}.{c}")) for c in NOT_NEGATIVE[table]]
    if table == "fact_daily_demand":
        rules.append(RowRule("revenue_non_negative", F.col("revenue") < 0, text("")))
        rules.append(
            RowRule(
                "stockout_consistency", F.col("quantity_fulfilled") > F.col("quantity_demanded"), text("more fulfilled than demanded"),
                applies=F.col("stockout_flag"),
            )
        )
    return rules


def fact_state(
    table: str, fact: DataFrame, dimensions: dict[str, DataFrame], dates: DataFrame, first: date, last: date
) -> DataFrame:
    """Key bitmap and rule counts of the rows of one load of a fact; `dimensions` holds the states of the dimensions."""
    flagged = fact
    for column, dimension in FOREIGN_KEYS.items():
        flagged = with_membership(flagged, column, dimensions[dimension], f"_found_{column}")
    outside = dates.filter((F.col("full_date") < F.lit(first)) | (F.col("full_date") > F.lit(last)))
    flagged = with_membership(flagged, "date_key", key_state(outside, "date_key"), "_outside")
    return key_state(flagged, FACTS[table], rule_counts(fact_rules(table, first, last)))


def merge_fact_states(table: str, states: DataFrame, first: date, last: date) -> DataFrame:
    """One state of those of several loads."""
    return states.groupBy("bucket").agg(
        F.sum("rows").alias("rows"), F.bitmap_or_agg("bits").alias("bits"), *summed_counts(fact_rules(table, first, last))
    )


def fact_report(table: str, state: DataFrame, source: DataFrame, first: date, last: date) -> DataFrame:
    """The checks of a fact from its merged state, without its rows."""
    rules = fact_rules(table, first, last)
    loaded = state.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
    return report([rule_rows(state.agg(*summed_counts(rules)), rules), same_row_count(f"completeness_{table}", source, loaded)])


def duplicate_check(table: str, key: str, df: DataFrame, state: DataFrame) -> DataFrame:
    totals = repeated_keys(df, key, state).withColumn("c", state.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar())
    return as_rows(totals, [check_row(f"dup_pk_{table}", F.col("c"), F.col("n"), F.lit(f"{table}.{key}"))])


def feature_checks(features: DataFrame, demand: DataFrame, skus: DataFrame, sites: DataFrame) -> DataFrame:
    """5 checks of the feature store; the lag check looks at every row, not at a sample."""
    nulls = sum((F.col(c).isNull().cast("int") for c in CALENDAR_COLUMNS), F.lit(0))
    negative = F.lit(False)
    for span in (7, 14, 28):
        negative = negative | (F.col(f"rolling_avg_{span}") < 0)
    totals = features.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls"), F.count_if(negative).alias("neg")
    )
    n_skus = skus.filter("active_flag").select(F.count_distinct("sku_id").alias("n")).scalar()
    n_sites = sites.select(F.count(F.lit(1)).alias("n")).scalar()
    totals = totals.withColumns({"skus": n_skus, "sites": n_sites})
    n, least = F.col("n"), F.col("skus") * F.col("sites")
    missing = F.greatest(least - n, F.lit(0))
    rows = as_rows(
        totals,
        [
            check_row(
                "calendar_nulls", n, F.col("nulls"),
                F.concat(grouped(F.col("nulls")), F.lit(" empty cells")),
            ),
            check_row(
                "rolling_avg_bounds", n, F.col("neg"), F.concat(grouped(F.col("neg")), F.lit(" below zero"))
            ),
            check_row(
                "row_count", n, missing,
                F.concat(grouped(n), F.lit(" of at least "), grouped(least)),
            ),
        ],
    )
    return report(
        [
            rows,
            lag_check(features, demand),
            duplicated_groups(
                features, "no_duplicates", ["sku_id", "warehouse_id", "feature_date"], sentence("{failed} repeated keys")
            ),
        ]
    )


def lag_check(features: DataFrame, demand: DataFrame) -> DataFrame:
    """lag_1 against the demand of the previous calendar day, where there is one; up to 5 % may differ."""
    keys = ["sku_id", "warehouse_id", "feature_date"]
    day_before = demand.select(
        "sku_id", "warehouse_id", F.date_add("feature_date", 1).alias("feature_date"), F.col("quantity_demanded").alias("_before")
    )
    pairs = features.filter("lag_1 is not null").select(*keys, "lag_1").join(day_before, keys)
    totals = pairs.agg(
        F.count(F.lit(1)).alias("c"), F.count_if(F.abs(F.col("lag_1") - F.col("_before")) > 0.01).alias("f")
    )
    c, f = F.col("c"), F.col("f")
    share = F.coalesce(F.try_divide(f * 100.0, c), F.lit(0.0))
    detail = F.concat(grouped(f), F.lit(" of "), grouped(c), F.lit(" differ"))
    status = F.when(share <= LAG_MISMATCH_PCT, "PASS").otherwise("FAIL")
    return as_rows(totals, [check_row("lag1_correctness", c, f, detail, status)])


def forecast_checks(
    run_log: DataFrame,
    forecasts: DataFrame,
    demand_pairs: DataFrame,
    skus: DataFrame,
    metric_history: DataFrame,
    models: int,
    horizon: int,
) -> DataFrame:
    """5 checks of a forecast run; drift and growth compare the last two runs of the metric history."""
    steps = run_row_rules(
        latest_run(run_log) if "run_id" in run_log.columns else run_log,
        [
            RowRule(
                "run_steps_completed", ~F.col("status").isin(*PASSING_STATUSES), sentence("{failed} of {checked} not completed")
            )
        ],
    )
    expected = demand_pairs.select("sku_id", "warehouse_id").distinct().agg((F.count(F.lit(1)) * models * horizon).alias("n")).scalar()
    rows = forecasts.agg(F.count(F.lit(1)).alias("c")).withColumn("e", expected)
    c, e = F.col("c"), F.col("e")
    within = c.between(e * (1 - ROW_COUNT_TOLERANCE), e * (1 + ROW_COUNT_TOLERANCE))
    row_count = as_rows(
        rows,
        [
            check_row(
                "forecast_row_count", c, F.when(within, 0).otherwise(F.abs(c - e)),
                F.concat(grouped(c), F.lit(" where "), grouped(e), F.lit(" are usual")),
            )
        ],
    )
    active = skus.filter("active_flag").select("sku_id").distinct()
    with_forecast = forecasts.select("sku_id").distinct().withColumn("_has", F.lit(True))
    coverage = run_row_rules(
        active.join(with_forecast, "sku_id", "left"),
        [RowRule("no_missing_skus", F.col("_has").isNull(), sentence("{failed} of {checked} not forecast"))],
    )
    return report([steps, row_count, coverage, *history_checks(metric_history)])


def latest_run(run_log: DataFrame) -> DataFrame:
    """The steps of the latest run; the log keeps all runs."""
    return run_log.join(F.broadcast(run_log.agg(F.max("run_id").alias("run_id"))), "run_id", "left_semi")


def metric_drift(history: DataFrame) -> DataFrame:
    """Per run: mean MAPE and feature rows against the run before, the one with the largest smaller id."""
    runs = F.array_sort(F.collect_list(F.struct("run_id", "avg_mape", "n_evaluations", "feature_rows")))
    listed = history.agg(runs.alias("runs"))  # one entry for each run ever made
    pairs = F.transform("runs", lambda run, at: F.struct(run["run_id"].alias("run_id"), run.alias("run"), F.get("runs", at - 1).alias("prior")))
    mape, prior = F.col("run.avg_mape"), F.col("prior.avg_mape")
    drift = F.when(prior > 0, (mape - prior) / prior).when(prior.isNotNull(), 0.0)
    grown = F.col("run.feature_rows") >= F.col("prior.feature_rows")
    return listed.select(F.inline(pairs)).select(
        "run_id",
        rounded(mape, 4).alias("avg_mape"),
        rounded(prior, 4).alias("prior_mape"),
        rounded(drift * 100, 1).alias("drift_pct"),
        F.when(mape.isNull() | (F.col("run.n_evaluations") == 0), "WARN")
        .when(drift > MAPE_DRIFT, "FAIL")
        .otherwise("PASS")
        .alias("drift_status"),
        F.col("run.n_evaluations").alias("n_evaluations"),
        F.col("run.feature_rows").alias("feature_rows"),
        F.col("prior.feature_rows").alias("prior_rows"),
        F.when(F.col("run.feature_rows") == 0, "FAIL")
        .when(F.col("prior.feature_rows").isNull() | grown, "PASS")
        .otherwise("FAIL")
        .alias("growth_status"),
    )


def history_checks(history: DataFrame) -> list[DataFrame]:
    latest = metric_drift(history).orderBy(F.desc("run_id")).limit(1)
    drift_detail = F.concat_ws(
        "", F.format_string("%.4f", "avg_mape"),
        F.when(F.col("prior_mape").isNull(), F.lit(" first run")).otherwise(
            F.concat(F.lit(" after "), F.format_string("%.4f", "prior_mape"))
        ),
    )
    growth_detail = F.concat_ws("", grouped(F.col("feature_rows")), F.lit(" after "), grouped(F.col("prior_rows")))
    zero = F.lit(0)
    return [
        as_rows(latest, [check_row("mape_drift", F.col("n_evaluations"), zero, drift_detail, F.col("drift_status"))]),
        as_rows(latest, [check_row("feature_store_growth", F.col("feature_rows"), zero, growth_detail, F.col("growth_status"))]),
    ]


def customer_checks(customers: DataFrame, scores: DataFrame, assignments: DataFrame) -> DataFrame:
    """6 checks: unique customers, score orphans and bounds, test contamination, conversion dates, champion share."""
    bad_score = F.lit(False)
    for c in ("recency_score", "frequency_score", "monetary_score"):
        bad_score = bad_score | ~F.col(c).between(1, 5)
    flagged = with_reference_flags(scores, {"customer_id": (customers, "customer_id")})
    score_rules = run_row_rules(
        flagged,
        [
            RowRule(
                "rfm_referential_integrity", F.col("_found_customer_id").isNull(),
                sentence("{failed} of {checked} unknown"),
            ),
            RowRule("rfm_score_bounds", bad_score, sentence("{failed} of {checked} outside 1..5")),
        ],
    )
    mixed = assignments.groupBy("customer_id", "test_name").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("test_group").alias("_low"), F.max("test_group").alias("_high")
    )
    totals = mixed.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("c"), F.count_if(F.col("_low") != F.col("_high")).alias("f")
    )
    contamination = as_rows(
        totals,
        [
            check_row(
                "no_ab_test_contamination", F.col("c"), F.col("f"),
                F.concat(grouped(F.col("f")), F.lit(" in both groups")),
            )
        ],
    )
    order = run_row_rules(
        assignments,
        [
            RowRule(
                "conversion_date_order", F.col("assigned_at").cast("date") >= F.col("conversion_date"),
                sentence("{failed} of {checked} too early"),
                applies=F.col("converted_flag") & F.col("conversion_date").isNotNull(),
            )
        ],
    )
    scored = F.col("active_flag") & F.col("current_rfm_segment").isNotNull()
    champions = customers.agg(
        F.count_if(scored).alias("c"), F.count_if(scored & (F.col("current_rfm_segment") == "Champions")).alias("h")
    )
    c, h = F.col("c"), F.col("h")
    passes = h * 100.0 <= c * CHAMPION_MAX_PCT
    share = as_rows(
        champions,
        [
            check_row(
                "segment_distribution", c, F.when(passes, 0).otherwise(h),
                F.concat(grouped(h), F.lit(" of "), grouped(c)),
                F.when(c == 0, "WARN").when(passes, "PASS").otherwise("FAIL"),
            )
        ],
    )
    return report([surplus_rows(customers, "no_duplicate_customers", "customer_id"), score_rules, contamination, order, share])


def task_checks(tasks: DataFrame, sites: DataFrame) -> DataFrame:
    """7 checks of warehouse tasks; four row rules share one pass."""
    duration = F.col("duration_min")
    flagged = with_reference_flags(tasks, {"warehouse_id": (sites, "warehouse_id")})
    rules = run_row_rules(
        flagged,
        [
            RowRule(
                "duration_bounds", duration.isNotNull() & ((duration <= 0) | (duration > DURATION_MAX_MINUTES)),
                sentence("{failed} of {checked} out of bounds"), "WARN",
            ),
            RowRule("accuracy_flag_values", F.col("accuracy_flag").isNull(), sentence("{failed} empty")),
            RowRule(
                "error_code_consistency",
                F.col("accuracy_flag") & F.col("error_code").isNotNull() & ~F.col("error_code").isin("", "None"),
                sentence("{failed} accurate with a code"), "WARN",
            ),
            RowRule(
                "warehouse_ref_integrity", F.col("_found_warehouse_id").isNull(),
                sentence("{failed} of {checked} unknown"),
            ),
        ],
    )
    daily = tasks.filter("task_type = 'Pick'").groupBy("warehouse_id", "task_date").agg(F.count(F.lit(1)).alias("n"))
    shifts = (
        tasks.filter("operator_surrogate_id > 0")
        .groupBy("operator_surrogate_id", "task_date", "shift")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    band = ~F.col("n").between(*PICKS_PER_DAY)
    volume = _group_check(
        daily.agg(F.count(F.lit(1)).alias("c"), F.count_if(band).alias("f")), "daily_pick_volume",
        "site days out of band",
    )
    spread = shifts.agg(F.struct(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"))).scalar()
    measured = shifts.withColumn("_all", spread)
    far = F.abs(F.col("n") - F.col("_all.mean")) > F.col("_all.std") * OUTLIER_DEVIATIONS
    outliers = _group_check(
        measured.agg(F.count(F.lit(1)).alias("c"), F.count_if(far).alias("f")), "operator_productivity",
        "shifts far from the mean",
    )
    return report([rules, surplus_rows(tasks, "no_duplicate_task_ids", "task_id"), volume, outliers])


def _group_check(totals: DataFrame, name: str, what: str) -> DataFrame:
    """WARN when any group is out of line, and when there is no group at all."""
    c, f = F.col("c"), F.col("f")
    status: Column = F.when((c > 0) & (f == 0), "PASS").otherwise("WARN")
    detail = F.concat(F.lit(f"{what}: "), grouped(f), F.lit(" of "), grouped(c))
    return as_rows(totals, [check_row(name, c, f, detail, status)])
