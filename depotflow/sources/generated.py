"""Dimensions that are generated rather than read."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from depotflow.functions.dates import calendar_columns
from depotflow.operators.positions import with_dense_key

# The registered baseline models.
MODELS = (
    (1, "moving_average_14d", "baseline", "14-day moving average of historical demand", '{"window": 14}'),
    (2, "moving_average_28d", "baseline", "28-day moving average of historical demand", '{"window": 28}'),
    (3, "seasonal_naive", "baseline", "Seasonal naive: same weekday 4 weeks ago (28-day lag)", '{"lag_days": 28}'),
)


def days_between(bounds: DataFrame) -> DataFrame:
    """Every day from `first` to `last` of a one-row frame."""
    return bounds.select(F.explode(F.sequence("first", "last")).alias("full_date"))


def date_dimension(bounds: DataFrame) -> DataFrame:
    """Calendar with its attributes for the days of a one-row (first, last) frame."""
    columns = calendar_columns("full_date")
    return days_between(bounds).select(*[c.alias(n) for n, c in columns.items()])


def date_range(spark: SparkSession, first: date = date(2022, 1, 1), last: date = date(2023, 12, 31)) -> DataFrame:
    return spark.createDataFrame([(first, last)], "first date, last date")


def site_dimension(sites: DataFrame) -> DataFrame:
    """Site attributes with a dense key in id order; the sites are configuration, passed in by the caller."""
    return with_dense_key(sites, "warehouse_key", ["warehouse_id"])


def model_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(MODELS), "model_id int, model_name string, model_type string, description string, hyperparameters string"
    )
