"""A/B tests: registration, eligibility, exact split, outcomes and analysis."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from depotflow.functions.numbers import exact_sum, rounded
from depotflow.functions.stats import SIGNIFICANCE, two_proportions
from depotflow.operators.intervals import distinct_keys_overlapping, span
from depotflow.operators.joins import unknown
from depotflow.operators.positions import with_dense_key, with_position


@dataclass(frozen=True)
class Trial:
    name: str
    hypothesis: str
    target_segment: str
    primary_metric: str
    starts: date
    ends: date
    split_ratio: float = 0.5
    seed: int = 42


REGISTRY_SCHEMA = (
    "test_id bigint, test_name string, hypothesis string, target_segment string, primary_metric string, "
    "split_ratio double, test_start_date date, test_end_date date, status string"
)
ASSIGNMENT_SCHEMA = (
    "assignment_id bigint, customer_id string, test_name string, test_group string, assigned_at date, "
    "test_start_date date, test_end_date date, primary_metric_value double, converted_flag boolean, "
    "conversion_date date, revenue_post_assignment double"
)


def register(registry: DataFrame, trial: Trial) -> DataFrame:
    """Add the test unless one of that name exists (the registry has one row per test)."""
    spark = registry.sparkSession
    row = (
        0, trial.name, trial.hypothesis, trial.target_segment, trial.primary_metric,
        trial.split_ratio, trial.starts, trial.ends, "active",
    )
    next_id = registry.agg((F.coalesce(F.max("test_id"), F.lit(0)) + 1).cast("bigint")).scalar()
    fresh = unknown(spark.createDataFrame([row], REGISTRY_SCHEMA), registry, "test_name")
    return registry.unionByName(fresh.withColumn("test_id", next_id))


def eligible(customers: DataFrame, registry: DataFrame, assignments: DataFrame, trial: Trial) -> DataFrame:
    """Active customers of the target segment, not in this test and not in another active test at the same time."""
    others = registry.filter((F.col("status") == "active") & (F.col("test_name") != trial.name))
    spans = others.select("test_name", F.col("test_start_date").alias("_from"), F.col("test_end_date").alias("_to"))
    taken = assignments.select("customer_id", "test_name").join(spans, "test_name")
    wanted = registry.sparkSession.range(1).select(*span(F.lit(trial.starts), F.lit(trial.ends)))
    busy = distinct_keys_overlapping(taken, ("_from", "_to"), wanted, ("_wanted_from", "_wanted_to"), "customer_id").select("customer_id")
    own = assignments.filter(F.col("test_name") == trial.name).select("customer_id")
    target = customers.filter((F.col("current_rfm_segment") == trial.target_segment) & F.col("active_flag"))
    return unknown(target.select("customer_id"), busy.unionByName(own), "customer_id")


def assign(candidates: DataFrame, assignments: DataFrame, trial: Trial, assigned: date) -> DataFrame:
    """Existing assignments plus the candidates, the first floor(n * ratio) in hash order as test group."""
    order = F.md5(F.concat_ws("|", F.lit(str(trial.seed)), F.lit(trial.name), F.col("customer_id")))
    placed = with_position(candidates.withColumn("_hash", order), ["_hash", "customer_id"])
    in_test = placed.agg(F.floor(F.count(F.lit(1)) * F.lit(trial.split_ratio))).scalar()
    grouped = placed.select(
        "customer_id",
        F.lit(trial.name).alias("test_name"),
        F.when(F.col("position") < in_test, "test").otherwise("control").alias("test_group"),
        F.lit(assigned).alias("assigned_at"),
        F.lit(trial.starts).alias("test_start_date"),
        F.lit(trial.ends).alias("test_end_date"),
        F.lit(None).cast("double").alias("primary_metric_value"),
        F.lit(False).alias("converted_flag"),
        F.lit(None).cast("date").alias("conversion_date"),
        F.lit(0.0).alias("revenue_post_assignment"),
    )
    numbered = with_dense_key(grouped, "assignment_id", [F.col("test_group").desc(), "customer_id"], after=assignments)
    return assignments.unionByName(numbered)


def record_outcomes(assignments: DataFrame, orders: DataFrame, test_name: str) -> DataFrame:
    """Fill in conversion and revenue of one test from orders after assignment, up to the end of the test."""
    own = assignments.filter(F.col("test_name") == test_name)
    window = own.select("assignment_id", "customer_id", "assigned_at", "test_end_date")
    found = (
        orders.select("customer_id", "order_date", "revenue")
        .join(window, "customer_id")
        .filter((F.col("order_date") > F.col("assigned_at")) & (F.col("order_date") <= F.col("test_end_date")))
        .groupBy("assignment_id")
        .agg(F.min("order_date").alias("_first"), exact_sum("revenue").alias("_revenue"))
    )
    revenue = F.coalesce(F.col("_revenue"), F.lit(0.0))
    recorded = (
        own.join(found, "assignment_id", "left")
        .withColumns(
            {
                "converted_flag": F.col("_first").isNotNull(),
                "conversion_date": F.col("_first"),
                "revenue_post_assignment": revenue,
                "primary_metric_value": revenue,
            }
        )
        .select(*assignments.columns)
    )
    return assignments.filter(F.col("test_name") != test_name).unionByName(recorded)


def analyse(assignments: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per test: sizes, rates, lift, z-test, confidence interval, effect size and verdict on its registered segment."""
    in_group = lambda g: F.col("test_group") == g
    counts = assignments.groupBy("test_name").agg(
        F.count_if(in_group("test")).alias("n_test"),
        F.count_if(in_group("control")).alias("n_control"),
        F.count_if(in_group("test") & F.col("converted_flag")).alias("conversions_test"),
        F.count_if(in_group("control") & F.col("converted_flag")).alias("conversions_control"),
    )
    stats = two_proportions(
        F.col("conversions_test"), F.col("n_test"), F.col("conversions_control"), F.col("n_control")
    )
    targets = registry.select("test_name", "target_segment").dropDuplicates(["test_name"])
    full = counts.select("*", *[c.alias(f"_{n}") for n, c in stats.items()]).join(targets, "test_name", "left")
    significant = F.col("_p_value") < SIGNIFICANCE
    verdict = F.concat(
        F.when(significant & (F.col("_lift_pct") > 0), "adopt").when(significant, "reject").otherwise("undecided"),
        F.coalesce(F.concat(F.lit(" for "), F.col("target_segment")), F.lit("")),
        F.format_string(": %+.1f %% conversions, p %.3f", "_lift_pct", "_p_value"),
    )
    verdict = F.when(F.col("_lift_pct").isNotNull() & F.col("_p_value").isNotNull(), verdict)
    return full.select(
        "test_name",
        "n_test",
        "n_control",
        "conversions_test",
        "conversions_control",
        rounded("_rate_a", 4).alias("conversion_rate_test"),
        rounded("_rate_b", 4).alias("conversion_rate_control"),
        rounded("_lift_pct", 2).alias("lift_pct"),
        rounded("_z", 4).alias("z_statistic"),
        rounded("_p_value", 4).alias("p_value"),
        significant.alias("significant"),
        (significant & (F.col("_lift_pct") > 0)).alias("deploy"),
        rounded("_ci_low", 4).alias("ci_lower_95"),
        rounded("_ci_high", 4).alias("ci_upper_95"),
        rounded("_cohens_h", 4).alias("cohens_h"),
        verdict.alias("recommendation"),
    )
