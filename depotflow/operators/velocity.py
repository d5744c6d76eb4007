"""Pick-velocity classes by average-rank percentile inside each site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from depotflow.functions.rules import SLOWEST_CLASS, VELOCITY_FLOORS


def velocity_floors(frequency: DataFrame, site: str, count: str) -> DataFrame:
    """Per site the smallest pick count that reaches each class: columns floor_Hot, floor_Warm, floor_Cool.

    Works on the histogram of counts. Different counts c1 < c2 < ... of one site sum to at most its
    picks, so the histogram of a site has at most sqrt(2 * picks) rows and the window over it stays small.
    """
    histogram = frequency.groupBy(site, count).agg(F.count(F.lit(1)).alias("_peers"))
    below = Window.partitionBy(site).orderBy(count).rowsBetween(Window.unboundedPreceding, -1)
    ranked = histogram.select(
        site,
        count,
        (F.coalesce(F.sum("_peers").over(below), F.lit(0)) + (F.col("_peers") + 1) / 2).alias("_rank"),
        F.sum("_peers").over(Window.partitionBy(site)).alias("_items"),
    ).withColumn("_pct", F.col("_rank") / F.col("_items"))
    return ranked.groupBy(site).agg(
        *[F.min(F.when(F.col("_pct") >= floor, F.col(count))).alias(f"floor_{name}") for name, floor in VELOCITY_FLOORS]
    )


def classify_velocity(frequency: DataFrame, site: str, count: str) -> DataFrame:
    """Add velocity_class to (site, item, count) rows."""
    floors = velocity_floors(frequency, site, count)
    chain = F
    for name, _ in VELOCITY_FLOORS:
        chain = chain.when(F.col(count) >= F.col(f"floor_{name}"), name)
    return (
        frequency.join(floors, site)
        .withColumn("velocity_class", chain.otherwise(SLOWEST_CLASS))
        .select(*frequency.columns, "velocity_class")
    )
