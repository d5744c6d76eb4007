"""Operators, tasks, slotting, co-occurrence and the warehouse mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depotflow.functions.dates import lenient_date, month_of, quarter_label
from depotflow.functions.numbers import exact_mean, percent, ratio, rounded, to_double, to_whole
from depotflow.functions.rules import WORKING_DAYS_PER_YEAR, daily_minutes_saved, slot_target, zone_by_hash
from depotflow.functions.text import anonymous_id, missing_to_null, to_boolean
from depotflow.operators.baskets import best_pairs, cooccurring_pairs
from depotflow.operators.joins import lookup, unknown
from depotflow.operators.positions import with_dense_key
from depotflow.operators.velocity import classify_velocity
from depotflow.operators.versions import apply_batch, not_yet_loaded

LOCATION_TRIGGERS = ["zone", "storage_type", "active_flag"]
UNKNOWN_OPERATOR = 0

# Texts of the mart and the export.
ADJACENCY_ADVICE = "Store in adjacent bays to reduce pick path distance"
EXPORT_ADVICE = "Consider adjacent slotting — high co-pick frequency"
PAIRS_STORED_PER_SITE = 200
PAIRS_SHOWN_PER_SITE = 50


def load_locations(history: DataFrame, batch: DataFrame, loaded_at: Column) -> DataFrame:
    return apply_batch(history, batch, "location_id", LOCATION_TRIGGERS, "location_surrogate_id", loaded_at)


def operators_seen(tasks: DataFrame) -> DataFrame:
    """Anonymous id, first site and cohort of each raw operator id (on the first day at two sites: the smaller site id).

    Different raw ids can share the 32-bit anonymous id; such operators count as one, with the earliest day.
    """
    per_site = (
        tasks.filter("operator_id is not null")
        .groupBy("operator_id", "warehouse_id")
        .agg(F.min("task_date").alias("_day"))
    )  # hashing and ordering start after the rows have collapsed
    return (
        per_site.groupBy(anonymous_id("operator_id").alias("operator_id"))
        .agg(F.min("_day").alias("_first"), F.min_by("warehouse_id", F.struct("_day", "warehouse_id")).alias("warehouse_id"))
        .select("operator_id", "warehouse_id", quarter_label("_first").alias("hire_date_cohort"), F.lit(True).alias("active_flag"))
    )


def load_operators(current: DataFrame, tasks: DataFrame) -> DataFrame:
    """Add operators not seen before, with the next surrogate ids."""
    fresh = unknown(operators_seen(tasks), current, "operator_id")
    numbered = with_dense_key(fresh, "operator_surrogate_id", ["operator_id"], after=current)
    return current.unionByName(numbered)


def clean_tasks(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "task_date": lenient_date("task_date"),
            "duration_min": to_double("duration_min"),
            "quantity": to_whole("quantity", 0),
            "accuracy_flag": to_boolean("accuracy_flag"),
            "error_code": missing_to_null("error_code"),
        }
    )


def new_tasks(raw: DataFrame, loaded: DataFrame, operators: DataFrame) -> DataFrame:
    """Tasks with new ids; an operator the dimension does not hold becomes 0, the location is not in the source."""
    fresh = not_yet_loaded(clean_tasks(raw), loaded, "task_id").withColumn("_anon", anonymous_id("operator_id"))
    keyed = lookup(fresh, operators, {"_anon": "operator_id"}, ["operator_surrogate_id"])
    return keyed.select(
        "task_id", "sku_id", F.lit(None).cast("string").alias("location_id"), "warehouse_id",
        F.coalesce("operator_surrogate_id", F.lit(UNKNOWN_OPERATOR)).cast("bigint").alias("operator_surrogate_id"),
        "task_date", "task_type", "shift", "duration_min", "quantity", "accuracy_flag", "error_code",
    )


def latest_day(tasks: DataFrame) -> Column:
    return tasks.agg(F.max("task_date")).scalar()


def daily_kpis(tasks: DataFrame) -> DataFrame:
    """Site, day and task type over the last 30 days, both ends included."""
    recent = tasks.filter(F.col("task_date") >= F.date_sub(latest_day(tasks), 30))
    return recent.groupBy("warehouse_id", "task_date", "task_type").agg(
        F.count(F.lit(1)).alias("tasks_completed"),
        percent(F.count_if("accuracy_flag"), F.count(F.lit(1))).alias("accuracy_rate_pct"),
        rounded(exact_mean("duration_min"), 2).alias("avg_duration_min"),
        F.sum("quantity").alias("total_quantity"),
    )


def operator_scorecard(tasks: DataFrame, operators: DataFrame) -> DataFrame:
    """Known operators in the month of the latest task.

    Rows collapse to (operator, site, day, shift, type) first, so a busy operator reaches the
    distinct counts with at most shifts x types rows.
    """
    month = tasks.filter(
        (month_of("task_date") == month_of(latest_day(tasks))) & (F.col("operator_surrogate_id") > UNKNOWN_OPERATOR)
    )
    keys = ["operator_surrogate_id", "warehouse_id"]
    cells = month.groupBy(*keys, "task_date", "shift", "task_type").agg(
        F.count(F.lit(1)).alias("_tasks"),
        F.count_if("accuracy_flag").alias("_right"),
        F.count_if(~F.col("accuracy_flag")).alias("_wrong"),
    )
    cards = cells.groupBy(*keys).agg(
        F.sum("_tasks").alias("total_tasks"),
        F.count_distinct(F.concat_ws("-", F.col("task_date").cast("string"), "shift")).alias("shifts_worked"),
        F.sum("_right").alias("_right"),
        F.sum("_wrong").alias("error_count"),
        F.count_distinct("task_type").alias("task_types_performed"),
    )
    return lookup(
        cards, operators, {"operator_surrogate_id": "operator_surrogate_id"}, ["hire_date_cohort"]
    ).select(
        "operator_surrogate_id", "hire_date_cohort", "warehouse_id", "total_tasks", "shifts_worked",
        rounded(ratio("total_tasks", "shifts_worked"), 1).alias("tasks_per_shift"),
        percent("_right", "total_tasks").alias("accuracy_rate_pct"),
        "error_count", "task_types_performed",
    )


def pick_frequency(tasks: DataFrame, lookback_days: int) -> DataFrame:
    """Picks per site and item since the latest day minus the look-back."""
    picks = tasks.filter(
        (F.col("task_type") == "Pick")
        & (F.col("task_date") >= F.date_sub(latest_day(tasks), lookback_days))
        & F.col("warehouse_id").isNotNull()
        & F.col("sku_id").isNotNull()
    )
    return picks.groupBy("warehouse_id", "sku_id").agg(F.count(F.lit(1)).alias("pick_count"))


def sku_velocity(tasks: DataFrame, lookback_days: int = 90) -> DataFrame:
    return classify_velocity(pick_frequency(tasks, lookback_days), "warehouse_id", "pick_count")


def site_zones(locations: DataFrame) -> DataFrame:
    """Sorted zones in use per site; the set has one entry per zone name."""
    return (
        locations.filter("is_current").groupBy("warehouse_id").agg(F.sort_array(F.collect_set("zone")).alias("_zones"))
    )


def slot_moves(velocity: DataFrame, locations: DataFrame) -> DataFrame:
    """Items that lie in the wrong zone for their velocity."""
    zoned = lookup(velocity, site_zones(locations), {"warehouse_id": "warehouse_id"}, ["_zones"])
    zoned = zoned.withColumn("prior_zone", zone_by_hash(F.col("sku_id"), F.col("warehouse_id"), F.col("_zones")))
    return (
        zoned.withColumn("recommended_zone", slot_target(F.col("velocity_class"), F.col("prior_zone")))
        .filter("recommended_zone is not null")
        .drop("_zones")
    )


HISTORY = """slotting_id bigint, sku_id string, warehouse_id string, recommendation_date date, prior_zone string,
    recommended_zone string, pick_frequency_at_recommendation bigint, estimated_daily_minutes_saved double,
    implementation_status string, implementation_date date, actual_minutes_saved_post double"""


def recommend(tasks: DataFrame, locations: DataFrame, history: DataFrame, lookback_days: int = 90) -> DataFrame:
    """New history: a pending recommendation for each misplaced item that has none pending."""
    pending = history.filter("implementation_status = 'pending'").select("sku_id", "warehouse_id")
    moves = slot_moves(sku_velocity(tasks, lookback_days), locations).join(pending, ["sku_id", "warehouse_id"], "left_anti")
    fresh = moves.select(
        "sku_id",
        "warehouse_id",
        latest_day(tasks).alias("recommendation_date"),
        "prior_zone",
        "recommended_zone",
        F.col("pick_count").alias("pick_frequency_at_recommendation"),
        rounded(daily_minutes_saved(F.col("pick_count"), lookback_days), 2).alias("estimated_daily_minutes_saved"),
        F.lit("pending").alias("implementation_status"),
        F.lit(None).cast("date").alias("implementation_date"),
        F.lit(None).cast("double").alias("actual_minutes_saved_post"),
    )
    return history.unionByName(with_dense_key(fresh, "slotting_id", ["warehouse_id", "sku_id"], after=history))


def decide(history: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply decisions (sku_id, warehouse_id, new_status, decided_on) to pending recommendations."""
    applies = (F.col("implementation_status") == "pending") & F.col("new_status").isNotNull()
    implemented = applies & (F.col("new_status") == "implemented")
    return (
        history.join(decisions, ["sku_id", "warehouse_id"], "left")
        .withColumns(
            {
                "implementation_date": F.when(implemented, F.col("decided_on")).otherwise(F.col("implementation_date")),
                "implementation_status": F.when(applies, F.col("new_status")).otherwise(F.col("implementation_status")),
            }
        )
        .select(*history.columns)
    )


def slotting_queue(history: DataFrame) -> DataFrame:
    """Pending recommendations with yearly savings."""
    saved = F.col("estimated_daily_minutes_saved")
    return history.filter("implementation_status = 'pending'").select(
        "slotting_id", "sku_id", "warehouse_id", "recommendation_date", "prior_zone", "recommended_zone",
        "pick_frequency_at_recommendation",
        rounded(saved, 2).alias("est_daily_minutes_saved"),
        rounded(saved * WORKING_DAYS_PER_YEAR, 1).alias("est_annual_minutes_saved"),
        "implementation_status",
    )


def realised_savings(history: DataFrame, tasks: DataFrame) -> DataFrame:
    """Mean pick minutes before the recommendation against after the implementation, for all implemented rows."""
    done = history.filter("implementation_status = 'implemented' and implementation_date is not null").select(
        "slotting_id", "sku_id", "warehouse_id", "recommendation_date", "implementation_date", "estimated_daily_minutes_saved"
    )
    daily = (
        tasks.filter("task_type = 'Pick' and duration_min is not null")
        .groupBy("sku_id", "warehouse_id", "task_date")
        .agg(F.sum(F.col("duration_min").cast("decimal(18,4)")).alias("_minutes"), F.count(F.lit(1)).alias("_picks"))
    )  # at most one row per item, site and day meets the join
    before, after = F.col("task_date") < F.col("recommendation_date"), F.col("task_date") > F.col("implementation_date")

    def mean(when: Column) -> Column:
        return F.try_divide(
            F.sum(F.when(when, F.col("_minutes"))).cast("double"), F.sum(F.when(when, F.col("_picks"))).cast("double")
        )

    saved = F.coalesce(F.col("_pre"), F.lit(0.0)) - F.coalesce(F.col("_post"), F.lit(0.0))
    return (
        done.join(daily, ["sku_id", "warehouse_id"], "left")
        .groupBy(*done.columns)
        .agg(mean(before).alias("_pre"), mean(after).alias("_post"))
        .select(
            "slotting_id", "sku_id", "warehouse_id", "estimated_daily_minutes_saved",
            rounded(saved, 4).alias("actual_minutes_saved_post"),
            rounded(
                F.try_divide(rounded(saved, 4), F.col("estimated_daily_minutes_saved")) * 100, 1
            ).alias("realisation_pct"),
        )
    )


def cooccurrence(tasks: DataFrame, probe: int = 512) -> DataFrame:
    """The 200 pairs with the highest lift per site; a session is one site, day and shift."""
    pairs = cooccurring_pairs(
        tasks.filter("task_type = 'Pick'"), "warehouse_id", ["task_date", "shift"], "sku_id", PAIRS_STORED_PER_SITE, probe
    )
    return pairs.select(
        "sku_id_1", "sku_id_2", "warehouse_id", "co_occurrence_count", F.lit("shift").alias("co_occurrence_window"), "lift_score"
    )


def adjacency(pairs: DataFrame) -> DataFrame:
    """The 50 best stored pairs per site."""
    return best_pairs(pairs.filter("lift_score > 1.0"), "warehouse_id", PAIRS_SHOWN_PER_SITE).select(
        "warehouse_id", "sku_id_1", "sku_id_2", "co_occurrence_count", "co_occurrence_window",
        rounded("lift_score", 3).alias("lift_score"),
        F.lit(ADJACENCY_ADVICE).alias("recommendation"),
    )


def adjacency_export(pairs: DataFrame) -> DataFrame:
    """Layout of the adjacency file."""
    return pairs.select(
        "sku_id_1", "sku_id_2", "warehouse_id", "co_occurrence_count", "lift_score", F.lit(EXPORT_ADVICE).alias("recommendation")
    )
