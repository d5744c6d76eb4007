"""Customer dimension, order load, RFM scores with history, and the commercial mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depotflow.functions.dates import lenient_date
from depotflow.functions.numbers import TOTAL, exact, exact_mean, exact_sum, not_below_zero, percent, rounded, to_double, to_whole
from depotflow.functions.rules import customer_segment
from depotflow.functions.text import snake_columns, to_boolean
from depotflow.operators.joins import first_per_key, known, unknown
from depotflow.operators.histograms import add_up, histogram, ranked, taken_out
from depotflow.operators.positions import quintile_scores
from depotflow.operators.versions import overwrite_columns, upsert
from depotflow.session import stage

# Texts of the mart.
AT_RISK_ACTION = "Re-engagement campaign — offer discount or account review"
CHAMPION_ACTION = "Upsell / loyalty programme — premium tier invitation"


def clean_customers(raw: DataFrame) -> DataFrame:
    df = snake_columns(raw)
    return df.withColumns(
        {
            "sla_hours": to_whole("sla_hours").cast("int"),
            "active_flag": to_boolean("active_flag"),
            "contract_since": lenient_date("contract_since"),
        }
    )


def load_customers(current: DataFrame, raw: DataFrame) -> DataFrame:
    """Insert new customers with empty metrics, update the attributes of known ones and keep their metrics."""
    empty = {"lifetime_orders": F.lit(0).cast("bigint"), "lifetime_revenue": F.lit(0.0)}
    clean = clean_customers(raw)
    return upsert(current, first_per_key(clean, ["customer_id"], clean.columns), "customer_id", empty)


def clean_orders(raw: DataFrame, tie_break: list[Column | str]) -> DataFrame:
    """Typed orders, one row per order id (first in the tie-break order)."""
    df = first_per_key(snake_columns(raw), ["order_id"], tie_break)
    df = df.withColumns(
        {
            "order_date": lenient_date("order_date"),
            "ship_date": lenient_date("ship_date"),
            "ordered_qty": to_whole("ordered_qty", 0),
            "shipped_qty": to_whole("shipped_qty", 0),
            "revenue": F.coalesce(to_double("revenue"), F.lit(0.0)),
            "on_time_flag": to_boolean("on_time_flag"),
            "in_full_flag": to_boolean("in_full_flag"),
            "otif_flag": to_boolean("otif_flag"),
        }
    )
    return df.withColumn("days_to_ship", not_below_zero(F.datediff("ship_date", "order_date")))


def new_orders(clean: DataFrame, customers: DataFrame, loaded: DataFrame) -> DataFrame:
    """Orders of known customers that are not loaded yet."""
    return unknown(known(clean, customers, "customer_id"), loaded, "order_id")


# Where an order goes.
ACCEPTED, LOADED, REJECTED = "accepted", "already loaded", "unknown customer"


def route_orders(clean: DataFrame, customers: DataFrame, loaded: DataFrame) -> DataFrame:
    """Every order with its verdict; an order without a customer has an unknown one."""
    people = customers.select(F.col("customer_id").alias("_person")).distinct().withColumn("_is_known", F.lit(True))
    orders = loaded.select(F.col("order_id").alias("_order")).distinct().withColumn("_is_loaded", F.lit(True))
    both = clean.join(people, F.col("customer_id") == F.col("_person"), "left").join(orders, F.col("order_id") == F.col("_order"), "left")
    verdict = F.when(F.col("_is_known").isNull(), REJECTED).when(F.col("_is_loaded"), LOADED).otherwise(ACCEPTED)
    return both.withColumn("verdict", verdict).select(*clean.columns, "verdict")


def rejected_orders(clean: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders of customers the dimension does not hold."""
    return unknown(clean, customers, "customer_id")


def lifetime_metrics(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.count(F.lit(1)).alias("lifetime_orders"),
        exact_sum("revenue").alias("lifetime_revenue"),
    )


def with_lifetime_metrics(customers: DataFrame, orders: DataFrame) -> DataFrame:
    return overwrite_columns(customers, lifetime_metrics(orders), "customer_id")


def rfm_base(orders: DataFrame) -> DataFrame:
    """What the scores need of each customer's orders; bases of parts of the orders merge."""
    return orders.groupBy("customer_id").agg(
        F.max("order_date").alias("_last"),
        F.count(F.lit(1)).alias("frequency_count"),
        exact_sum("revenue").alias("monetary_value"),
    )


def rfm_scores(orders: DataFrame, strict: bool = False) -> DataFrame:
    """Scores and segment of every customer with orders, as of the last order date."""
    return _with_scores(stage(rfm_base(orders)), None, strict)  # customer grain; the orders are scanned once


# The last order counts in days, so that a later scoring date does not change the histogram. Customers whose orders have no readable date count nowhere.
RFM_HISTOGRAM = {name: f"if(_last is null, null, {value})" for name, value in {
    "recency_days": "unix_date(_last)", "frequency_count": "frequency_count", "monetary_value": "monetary_value"}.items()}


def rfm_state(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base of each customer and histogram of the bases, both staged."""
    base = stage(rfm_base(orders))
    return base, stage(histogram(base, RFM_HISTOGRAM))


def advanced_rfm_state(base: DataFrame, hist: DataFrame, new_orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state after new orders; of the histogram only the values of customers with new orders change."""
    money = base.schema["monetary_value"].dataType
    fresh = rfm_base(new_orders).toDF("customer_id", "_last_new", "_frequency_new", "_monetary_new")
    met = stage(base.withColumn("_old", F.lit(True)).join(fresh.withColumn("_new", F.lit(True)), "customer_id", "full"))
    count = F.coalesce("frequency_count", F.lit(0)) + F.coalesce("_frequency_new", F.lit(0))
    none = F.lit(0.0)  # money adds up as decimals, so that no digit depends on how the orders were dealt over loads
    value = exact(F.coalesce("monetary_value", none), TOTAL) + exact(F.coalesce("_monetary_new", none), TOTAL)
    value = F.when(F.col("monetary_value").isNotNull() | F.col("_monetary_new").isNotNull(), value)
    grown = met.select(
        "customer_id", F.greatest("_last", "_last_new").alias("_last"), count.cast("bigint").alias("frequency_count"),
        value.cast(money).alias("monetary_value"), "_new",
    )
    out = taken_out(histogram(met.filter("_old and _new"), RFM_HISTOGRAM))
    after = add_up(hist, out, histogram(grown.filter("_new"), RFM_HISTOGRAM))
    return stage(grown.drop("_new")), stage(after)


def rfm_scores_of_state(base: DataFrame, hist: DataFrame, strict: bool = False) -> DataFrame:
    """`rfm_scores` of all orders behind a state, without reading or sorting them."""
    return _with_scores(base, hist, strict)


def _with_scores(base: DataFrame, hist: DataFrame | None, strict: bool) -> DataFrame:
    scoring_date = base.agg(F.max("_last")).scalar()
    ranks = None
    if hist is not None:
        days = F.unix_date(scoring_date) - F.col("value")
        ranks = ranked(hist.withColumn("value", F.when(F.col("metric") == "recency_days", days).otherwise(F.col("value"))))
    base = base.withColumn("scoring_date", scoring_date)
    base = base.withColumn("recency_days", F.datediff("scoring_date", "_last"))
    # an order without a readable date cannot be placed in time: such customers have no recency
    base = base.filter("recency_days is not null")
    scored = quintile_scores(
        base, "customer_id", {"recency_days": True, "frequency_count": False, "monetary_value": False}, ranks
    )
    scores = {
        "recency_score": F.col("recency_days_score"),
        "frequency_score": F.col("frequency_count_score"),
        "monetary_score": F.col("monetary_value_score"),
    }
    return scored.select(
        "customer_id", "scoring_date", "recency_days", "frequency_count", "monetary_value",
        *[c.alias(n) for n, c in scores.items()],
        customer_segment(*scores.values(), strict=strict).alias("rfm_segment"),
    )


def segment_distribution(scores: DataFrame) -> DataFrame:
    """Customers and share per segment."""
    counts = scores.groupBy(F.col("rfm_segment").alias("segment"), "scoring_date").agg(
        F.count(F.lit(1)).alias("customer_count")
    )
    total = counts.agg(F.sum("customer_count")).scalar()
    return counts.select("segment", "customer_count", percent("customer_count", total).alias("pct_of_total"), "scoring_date")


def with_segment(customers: DataFrame, scores: DataFrame) -> DataFrame:
    """Write the current segment back to the dimension."""
    fresh = scores.select("customer_id", F.col("rfm_segment").alias("current_rfm_segment"))
    return overwrite_columns(customers, fresh, "customer_id")


def _scored(customers: DataFrame, scores: DataFrame, how: str) -> DataFrame:
    current = scores.filter("is_current_flag").select(
        "customer_id", "recency_days", "frequency_count", "monetary_value",
        "recency_score", "frequency_score", "monetary_score", "scoring_date",
    )
    return customers.filter("active_flag").join(current, "customer_id", how)


PROFILE = ["customer_id", "customer_type", "region", "annual_rev_band", "sla_hours"]
SCORES = ["recency_score", "frequency_score", "monetary_score"]


def customer_segments(customers: DataFrame, scores: DataFrame) -> DataFrame:
    """Active customers with their current score, if any."""
    return _scored(customers, scores, "left").select(
        *PROFILE,
        "active_flag",
        F.col("current_rfm_segment").alias("rfm_segment"),
        "recency_days",
        "frequency_count",
        rounded("monetary_value", 2).alias("monetary_value"),
        *SCORES,
        "scoring_date",
        "last_order_date",
        rounded("lifetime_revenue", 2).alias("lifetime_revenue"),
        "lifetime_orders",
    )


def customer_list(customers: DataFrame, scores: DataFrame, segment: str, action: str) -> DataFrame:
    """Active scored customers of one segment with a recommended action."""
    return _scored(customers.filter(F.col("current_rfm_segment") == segment), scores, "inner").select(
        *PROFILE,
        "recency_days",
        "frequency_count",
        rounded("monetary_value", 2).alias("monetary_value"),
        *SCORES,
        "last_order_date",
        rounded("lifetime_revenue", 2).alias("lifetime_revenue"),
        "lifetime_orders",
        "scoring_date",
        F.lit(action).alias("recommended_action"),
    )


def segment_performance(customers: DataFrame, scores: DataFrame, orders: DataFrame) -> DataFrame:
    """KPIs per segment; orders are counted per customer first, so each customer weighs once."""
    per_customer = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("_orders"), F.count_if("otif_flag").alias("_otif")
    )
    joined = _scored(customers.filter("current_rfm_segment is not null"), scores, "left").join(
        per_customer, "customer_id", "left"
    )

    def mean(c: str, digits: int) -> Column:
        return rounded(exact_mean(c, TOTAL), digits)

    return joined.groupBy(F.col("current_rfm_segment").alias("segment")).agg(
        F.count(F.lit(1)).alias("customer_count"),
        mean("lifetime_revenue", 2).alias("avg_lifetime_revenue"),
        rounded(exact_sum("lifetime_revenue", TOTAL), 2).alias("total_segment_revenue"),
        mean("lifetime_orders", 1).alias("avg_orders_per_customer"),
        percent(F.sum("_otif"), F.sum("_orders")).alias("otif_rate_pct"),
        mean("recency_days", 0).alias("avg_recency_days"),
        mean("frequency_count", 1).alias("avg_frequency"),
        mean("monetary_value", 2).alias("avg_monetary"),
    )
