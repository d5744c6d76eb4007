"""Feature store, baseline forecasts, holdout evaluation, best model per class and the planner export."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from depotflow.functions.numbers import rounded
from depotflow.operators.joins import first_per_key
from depotflow.operators.series import (
    DEVIATION_SPANS,
    LAGS,
    MEAN_SPANS,
    demand_features,
    features_after,
    merge_series,
    series_state,
    tail_statistics,
)

# Fixed values of the forecast.
HORIZON_DAYS = 30
CONFIDENCE_LEVEL = 0.80
Z_OF_CONFIDENCE = 1.282
DEFAULT_MODEL = 1
FIRST_LOAD_MARK = date(2021, 12, 31)
SERIES = ["sku_id", "warehouse_id"]
FEATURES = [
    *[f"lag_{n}" for n in LAGS], *[f"rolling_avg_{n}" for n in MEAN_SPANS], *[f"rolling_std_{n}" for n in DEVIATION_SPANS],
]

# Model id -> prediction from a row of the feature store (evaluation).
MODEL_FEATURES: dict[int, Column | str] = {1: "rolling_avg_14", 2: "rolling_avg_28", 3: "lag_28"}
# Model id -> forecast from the tail statistics of a series.
MODEL_FORECASTS: dict[int, Column | str] = {1: "mean_14", 2: "mean_28", 3: "naive_28"}


def active_demand(fact: DataFrame, dates: DataFrame, skus: DataFrame, sites: DataFrame) -> DataFrame:
    """Demand of active items, as (feature_date, sku_id, warehouse_id, classes, quantity)."""
    return (
        fact.select("date_key", "sku_key", "warehouse_key", "quantity_demanded")
        .join(dates.select("date_key", F.col("full_date").alias("feature_date")), "date_key")
        .join(skus.filter("active_flag").select("sku_key", "sku_id", "abc_class", "xyz_class"), "sku_key")
        .join(sites.select("warehouse_key", "warehouse_id"), "warehouse_key")
        .select("feature_date", *SERIES, "abc_class", "xyz_class", "quantity_demanded")
    )


def feature_store(demand: DataFrame, calendar: bool = False, expanding_fill: bool = False) -> DataFrame:
    features = demand_features(demand, SERIES, "feature_date", "quantity_demanded", calendar, expanding_fill)
    return features.drop("quantity_demanded")


def demand_state(demand: DataFrame) -> DataFrame:
    """What features of later days need of the days so far."""
    return series_state(demand, SERIES, "feature_date", "quantity_demanded")


def advanced_state(state: DataFrame, increment: DataFrame) -> DataFrame:
    return merge_series(state.unionByName(demand_state(increment)), SERIES)


def features_of_increment(increment: DataFrame, state: DataFrame) -> DataFrame:
    """Features of days after those of the state; no earlier day is read."""
    return features_after(increment, state, SERIES, "feature_date", "quantity_demanded").drop("quantity_demanded")


def baseline_forecasts(
    demand: DataFrame, basis_from: Column, starts: Column, models: dict[int, Column | str] = MODEL_FORECASTS
) -> DataFrame:
    """30 daily forecasts per series and model, constant over the horizon, with 80 % bounds."""
    tail = tail_statistics(demand.filter(F.col("feature_date") >= basis_from), SERIES, "feature_date", "quantity_demanded")
    points = [
        F.struct(F.lit(i).alias("model_id"), (F.col(m) if isinstance(m, str) else m).alias("point"))
        for i, m in models.items()
    ]
    margin = F.col("spread") * Z_OF_CONFIDENCE
    lower = rounded(F.col("point") - margin, 4)
    return (
        tail.select(*SERIES, "spread", F.inline(F.array(*points)))
        .withColumn("forecast_horizon_days", F.explode(F.sequence(F.lit(1), F.lit(HORIZON_DAYS))))
        .select(
            *SERIES,
            "model_id",
            F.date_add(starts, F.col("forecast_horizon_days") - 1).alias("forecast_date"),
            "forecast_horizon_days",
            rounded("point", 4).alias("forecasted_qty"),
            F.when(lower < 0, 0.0).otherwise(lower).alias("lower_bound"),
            rounded(F.col("point") + margin, 4).alias("upper_bound"),
            F.lit(CONFIDENCE_LEVEL).alias("confidence_level"),
        )
    )


def evaluate(
    demand: DataFrame,
    features: DataFrame,
    test_from: Column,
    test_to: Column,
    models: dict[int, Column | str] = MODEL_FEATURES,
    by_site: bool = False,
) -> DataFrame:
    """One-step-ahead errors on the holdout per model and item (optionally per site)."""
    days = F.col("feature_date").between(test_from, test_to)
    actual = demand.filter(days).select(*SERIES, "feature_date", "abc_class", F.col("quantity_demanded").alias("_actual"))
    predictions = [
        F.struct(F.lit(i).alias("model_id"), (F.col(m) if isinstance(m, str) else m).alias("_predicted"))
        for i, m in models.items()
    ]
    predicted = features.filter(days).select(*SERIES, "feature_date", F.array(*predictions).alias("_models"))
    error = F.col("_predicted") - F.col("_actual")
    scaled = F.when(F.col("_actual") > 0, F.abs(error) / F.col("_actual"))
    keys = ["model_id", *(SERIES if by_site else SERIES[:1]), "abc_class"]  # an item has one class
    return (
        actual.join(predicted, [*SERIES, "feature_date"])
        .select("sku_id", "warehouse_id", "abc_class", "_actual", F.inline("_models"))
        .filter("_predicted is not null")
        .groupBy(*keys)
        .agg(
            rounded(F.avg(scaled) * 100, 6).alias("mape"),
            rounded(F.sqrt(F.avg(error * error)), 6).alias("rmse"),
            rounded(F.avg(F.abs(error)), 6).alias("mae"),
            rounded(F.avg(error), 6).alias("bias"),
        )
    )


def error_by_class(performance: DataFrame) -> DataFrame:
    """Mean MAPE per class and model; items without a MAPE do not count."""
    mape = F.col("mape").cast("decimal(18,6)")
    return (
        performance.filter("mape is not null")
        .groupBy("abc_class", "model_id")
        .agg(rounded(F.sum(mape).cast("double") / F.count(mape), 6).alias("avg_mape"))
    )


def best_models(performance: DataFrame, classes: DataFrame) -> DataFrame:
    """Model with the lowest mean MAPE per class, lower id on ties; model 1 for a class without any error."""
    best = first_per_key(error_by_class(performance), ["abc_class"], ["avg_mape", "model_id"])
    return (
        classes.select("abc_class").distinct().join(best, "abc_class", "left")
        .withColumn("model_id", F.coalesce("model_id", F.lit(DEFAULT_MODEL)))
    )


def planner_forecast(forecasts: DataFrame, best: DataFrame, skus: DataFrame, models: DataFrame) -> DataFrame:
    """Forecasts of the best model of each item's class, with the planner's column names."""
    chosen = skus.join(best.select("abc_class", "model_id"), "abc_class")
    return (
        forecasts.join(chosen, ["sku_id", "model_id"])
        .join(models.select("model_id", "model_name"), "model_id")
        .select(
            F.col("sku_id").alias("SKU_ID"),
            F.col("category").alias("Category"),
            F.col("abc_class").alias("ABC_Class"),
            F.col("warehouse_id").alias("Warehouse_ID"),
            F.col("primary_warehouse").alias("Primary_Warehouse"),
            F.col("forecast_date").alias("Forecast_Date"),
            F.col("forecasted_qty").alias("Forecasted_Qty"),
            F.col("lower_bound").alias("Lower_Bound"),
            F.col("upper_bound").alias("Upper_Bound"),
            F.col("model_name").alias("Model_Used"),
        )
    )
