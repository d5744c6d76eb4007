"""Business rules as ordered WHEN chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from depotflow.functions.text import bucket_of

# Velocity classes by average-rank percentile, floor included.
VELOCITY_FLOORS = (("Hot", 0.90), ("Warm", 0.70), ("Cool", 0.40))
SLOWEST_CLASS = "Cold"
MINUTES_SAVED_PER_MOVE = 4.0
WORKING_DAYS_PER_YEAR = 260
DEFAULT_ZONE = "Reserve"


def customer_segment(r: Column, f: Column, m: Column, strict: bool = False) -> Column:
    """Segment from three scores of 1..5, first rule wins.

    "Can't Lose Them" lies inside "At Risk", so in the default order it never applies; `strict` tests it first.
    """
    def at_least(value: int, *scores: Column) -> Column:
        return reduce(lambda a, b: a & b, [score >= value for score in scores])

    at_risk = ("At Risk", (r <= 2) & at_least(3, f, m))
    cannot_lose = ("Can't Lose Them", (r <= 2) & at_least(4, f, m))
    rules = [
        ("Champions", at_least(4, r, f, m)),
        ("Loyal Customers", at_least(3, r, f, m)),
        ("New Customers", (r >= 4) & (f <= 2)),
        ("Potential Loyalists", (r >= 3) & (m >= 2)),
        *([cannot_lose, at_risk] if strict else [at_risk, cannot_lose]),
        ("Lost", (r == 1) & (f == 1)),
        ("Hibernating", (r <= 2) & (f <= 2) & (m <= 2)),
        ("Promising", (r >= 2) & (m >= 3)),
    ]
    chain = F
    for name, condition in rules:
        chain = chain.when(condition, name)
    return chain.otherwise("Need Attention")


def slot_target(velocity: Column, zone: Column) -> Column:
    """Zone the item should move to, NULL when it may stay."""
    on_face = zone == "Pick_Face"
    return F.when((velocity == "Hot") & ~on_face, "Pick_Face").when((velocity == "Cold") & on_face, "Reserve")


def zone_by_hash(sku: Column, site: Column, zones: Column) -> Column:
    """Stand-in for the stock position: one of the site's zones, picked by a stable hash of item and site."""
    count = F.coalesce(F.size(zones), F.lit(0))
    # greatest() keeps the modulus positive in the branch that is not taken
    index = bucket_of(F.concat(sku, site), F.greatest(count, F.lit(1)))
    return F.when(count > 0, F.try_element_at(zones, index + 1)).otherwise(DEFAULT_ZONE)


def daily_minutes_saved(picks: Column, lookback_days: int) -> Column:
    return picks * F.lit(MINUTES_SAVED_PER_MOVE) / F.lit(float(lookback_days))
