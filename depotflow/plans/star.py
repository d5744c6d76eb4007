"""Star schema: supplier and item dimensions, daily demand and inventory facts, and the documented mart queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depotflow.functions.dates import strict_date
from depotflow.functions.numbers import TOTAL, exact, exact_sum, not_below_zero, percent, ratio, rounded, to_double, to_whole
from depotflow.functions.text import snake_columns, to_boolean
from depotflow.operators.joins import lookup
from depotflow.operators.positions import with_dense_key
from depotflow.sources.files import with_optional

SUPPLIER_NUMBERS = ("lead_time_avg_days", "lead_time_std_days", "otif_rate", "fill_rate", "defect_rate")
ITEM_AMOUNTS = ("unit_cost", "unit_price", "weight_kg", "volume_cbm")
ITEM_COUNTS = ("lead_time_days", "min_order_qty", "safety_stock_qty", "reorder_point_qty")
STOCK_COUNTS = ("on_hand_qty", "in_transit_qty", "committed_qty", "available_qty")


def dim_supplier(raw: DataFrame) -> DataFrame:
    df = snake_columns(raw)
    df = df.withColumns({c: to_double(c) for c in SUPPLIER_NUMBERS} | {"active_flag": to_boolean("active_flag")})
    return with_dense_key(df, "supplier_key", ["supplier_id"])


def dim_sku(raw: DataFrame) -> DataFrame:
    df = snake_columns(raw)
    casts = {c: to_double(c) for c in ITEM_AMOUNTS} | {c: to_whole(c) for c in ITEM_COUNTS}
    df = with_optional(df.withColumns(casts | {"active_flag": to_boolean("active_flag")}), "xyz_class", "string")
    return with_dense_key(df, "sku_key", ["sku_id"])


def clean_demand(raw: DataFrame) -> DataFrame:
    """Typed demand rows with derived measures; a missing revenue (stock-out record) counts as 0."""
    df = snake_columns(raw).withColumns(
        {
            "date": strict_date("date"),
            "quantity_demanded": to_whole("quantity_demanded", 0),
            "quantity_fulfilled": to_whole("quantity_fulfilled", 0),
            "stockout_flag": to_boolean("stockout_flag"),
            "revenue": F.coalesce(to_double("revenue"), F.lit(0.0)),
        }
    )
    return df.withColumns(
        {
            "quantity_unfulfilled": not_below_zero(F.col("quantity_demanded") - F.col("quantity_fulfilled")),
            "fill_rate": ratio("quantity_fulfilled", "quantity_demanded"),
        }
    )


def with_star_keys(df: DataFrame, day: str, dates: DataFrame, skus: DataFrame, sites: DataFrame) -> DataFrame:
    df = lookup(df, dates, {day: "full_date"}, ["date_key"])
    df = lookup(df, skus.select("sku_id", "sku_key"), {"sku_id": "sku_id"}, ["sku_key"])
    return lookup(df, sites.select("warehouse_id", "warehouse_key"), {"warehouse_id": "warehouse_id"}, ["warehouse_key"])


def demand_rows(clean: DataFrame, dates: DataFrame, skus: DataFrame, sites: DataFrame) -> DataFrame:
    """Cleaned demand with dimension keys but no number of its own; rows without a partner keep a NULL key."""
    keyed = with_star_keys(clean, "date", dates, skus, sites)
    return keyed.select(
        "date_key", "sku_key", "warehouse_key", "abc_class", "xyz_class", "quantity_demanded", "quantity_fulfilled",
        "quantity_unfulfilled", "stockout_flag", "revenue", "fill_rate",
    )


def fact_daily_demand(rows: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """Number the demand rows in date order, which also lays the table out by date; `after` continues its numbers."""
    return with_dense_key(rows, "demand_key", ["date_key", "sku_key", "warehouse_key"], after)


def fact_inventory_snapshot(raw: DataFrame, dates: DataFrame, skus: DataFrame, sites: DataFrame) -> DataFrame:
    df = snake_columns(raw).withColumns(
        {"snapshot_date": strict_date("snapshot_date")}
        | {c: to_whole(c, 0) for c in STOCK_COUNTS}
        | {"inventory_value": F.coalesce(to_double("inventory_value"), F.lit(0.0))}
    )
    df = df.withColumn("inventory_record_accuracy", ratio("available_qty", "on_hand_qty"))
    keyed = with_star_keys(df, "snapshot_date", dates, skus, sites).select(
        "date_key", "sku_key", "warehouse_key", *STOCK_COUNTS, "inventory_value", "inventory_record_accuracy"
    )
    return with_dense_key(keyed, "snapshot_key", ["date_key", "sku_key", "warehouse_key"])


def star_join(fact: DataFrame, dates: DataFrame, skus: DataFrame, sites: DataFrame) -> DataFrame:
    """Fact rows with partners in all three dimensions."""
    return fact.join(dates, "date_key").join(skus, "sku_key").join(sites, "warehouse_key")


def _month(d: str) -> Column:
    return F.date_format(d, "yyyy-MM")


def monthly_revenue(fact: DataFrame, dates: DataFrame, skus: DataFrame, sites: DataFrame) -> DataFrame:
    """Revenue and demand by month, class and site."""
    joined = star_join(
        fact.select("date_key", "sku_key", "warehouse_key", "revenue", "quantity_demanded"),
        dates.select("date_key", "year", "month_num"),
        skus.select("sku_key", "abc_class"),
        sites.select("warehouse_key", "warehouse_id"),
    )
    return joined.groupBy("year", "month_num", "abc_class", "warehouse_id").agg(
        rounded(exact_sum("revenue", TOTAL), 2).alias("total_revenue"),
        F.sum("quantity_demanded").alias("units_demanded"),
        F.count(F.lit(1)).alias("demand_rows"),
    )


def top_stockout_items(fact: DataFrame, skus: DataFrame, n: int = 20) -> DataFrame:
    """Items with stock-outs, highest rate first."""
    rates = (
        fact.groupBy("sku_key")
        .agg(F.count(F.lit(1)).alias("total_days"), F.count_if("stockout_flag").alias("stockout_days"))
        .filter("stockout_days > 0")
    )
    return (
        rates.join(skus.select("sku_key", "sku_id", "category", "abc_class"), "sku_key")
        .select(
            "sku_id", "category", "abc_class", "total_days", "stockout_days",
            percent("stockout_days", "total_days").alias("stockout_rate_pct"),
        )
        .orderBy(F.desc("stockout_rate_pct"), F.desc("stockout_days"), "sku_id")
        .limit(n)
    )


def monthly_inventory_accuracy(fact: DataFrame, dates: DataFrame, sites: DataFrame) -> DataFrame:
    """Mean record accuracy and stock value by month and site."""
    joined = fact.join(dates.select("date_key", "year", "month_num"), "date_key").join(
        sites.select("warehouse_key", "warehouse_id"), "warehouse_key"
    )
    accuracy = F.col("inventory_record_accuracy").cast("decimal(18,9)")
    mean = F.try_divide(F.sum(accuracy).cast("double"), F.count(accuracy).cast("double"))
    return joined.groupBy("year", "month_num", "warehouse_id").agg(
        rounded(mean * 100, 2).alias("avg_accuracy_pct"),
        rounded(exact_sum("inventory_value", TOTAL), 2).alias("total_inventory_value"),
        F.count(F.lit(1)).alias("snapshot_rows"),
    )


def demand_by_supplier(fact: DataFrame, skus: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Demand per supplier, through the item; facts shrink to items before the joins."""
    per_item = fact.groupBy("sku_key").agg(
        F.sum("quantity_demanded").alias("_units"),
        F.sum("quantity_fulfilled").alias("_filled"),
        F.sum(exact("revenue", TOTAL)).alias("_revenue"),
    )
    return (
        per_item.join(skus.select("sku_key", "supplier_id"), "sku_key")
        .join(suppliers.select("supplier_id", "supplier_key", "supplier_name", "country"), "supplier_id")
        .groupBy("supplier_key", "supplier_id", "supplier_name", "country")
        .agg(
            F.count(F.lit(1)).alias("skus"),
            F.sum("_units").alias("units_demanded"),
            percent(F.sum("_filled"), F.sum("_units")).alias("fill_rate_pct"),
            rounded(F.sum("_revenue").cast("double"), 2).alias("total_revenue"),
        )
    )
