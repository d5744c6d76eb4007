"""Joins on time: intervals that overlap, and the version of a row that was valid at another row's moment.

Both become equi-joins on stretches of the calendar, so that no join compares every row with every other and a hot key is
spread over time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_DAYS = 32


def overlapping(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose closed date intervals share a day (and the columns `on`, if any); each pair once.

    An interval has a row for each month it touches; a pair counts in the first month that both touch. Rows without a start
    or end, and those that end before they start, meet nothing. The span columns must have different names.
    """
    on = on or []

    def by_month(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        start, end = (F.trunc(F.col(c), "month") for c in span)
        kept = df.filter(F.col(span[0]) <= F.col(span[1]))
        return kept.withColumn("_month", F.explode(F.sequence(start, end, F.expr("interval 1 month"))))

    (a, b), (c, d) = left_span, right_span
    met = by_month(left, left_span).join(by_month(right, right_span), [*on, "_month"])
    both = (F.col(a) <= F.col(d)) & (F.col(b) >= F.col(c)) & (F.col("_month") == F.trunc(F.greatest(a, c), "month"))
    return met.filter(both).drop("_month")


def as_of(
    facts: DataFrame, history: DataFrame, key: str, moment: str, take: list[str], days: int = BUCKET_DAYS,
    valid_from: str = "valid_from", valid_to: str = "valid_to",
) -> DataFrame:
    """`facts` with columns `take` of the version of their key that was valid at their moment; NULL where there was none.

    A version is valid from valid_from up to, but without, valid_to (NULL: still valid); versions of one key don't overlap.
    Time is cut into buckets of `days`. A version meets the facts of the bucket it starts in; for later buckets with facts of its key,
    the last version that started before is carried there, once for each bucket. So a fact meets the few versions of its
    own bucket only, and no version is repeated for all the time it was valid.
    """
    number = lambda c: F.floor(F.unix_date(F.to_date(c)) / days)
    version = F.struct(F.col(valid_from).cast("timestamp").alias("start"), F.col(valid_to).cast("timestamp").alias("stop"), *take)
    starts = history.filter(F.col(key).isNotNull() & F.col(valid_from).isNotNull()).select(
        F.col(key).alias("_key"), number(F.col(valid_from)).alias("_bucket"), version.alias("_version")
    )
    latest = starts.groupBy("_key", "_bucket").agg(F.max_by("_version", F.col("_version.start")).alias("_latest"))
    asked = facts.select(F.col(key).alias("_key"), number(F.col(moment)).alias("_bucket")).filter("_key is not null and _bucket is not null").distinct()
    # one row for each key and bucket with facts or starts, so a key has no more of them than the calendar has buckets
    line = asked.withColumn("_wanted", F.lit(True)).join(latest, ["_key", "_bucket"], "full")
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = line.withColumn("_version", F.last("_latest", ignorenulls=True).over(before)).filter("_wanted and _version is not null")
    versions = starts.unionByName(carried.select("_key", "_bucket", "_version"))
    at = F.col(moment).cast("timestamp")
    valid = (F.col("_version.start") <= at) & (F.col("_version.stop").isNull() | (F.col("_version.stop") > at))
    joined = facts.join(versions, (F.col(key) == F.col("_key")) & (number(F.col(moment)) == F.col("_bucket")) & valid, "left")
    return joined.select(*facts.columns, *[F.col(f"_version.{c}").alias(c) for c in take])


def distinct_keys_overlapping(rows: DataFrame, row_span: tuple[str, str], wanted: DataFrame, wanted_span: tuple[str, str], key: str) -> DataFrame:
    """(key, columns of `wanted`): keys with a row whose interval overlaps a wanted one."""
    pairs = overlapping(rows.select(key, *row_span), wanted, row_span, wanted_span)
    return pairs.select(key, *wanted.columns).distinct()


def span(start: Column, end: Column) -> list[Column]:
    return [start.cast("date").alias("_wanted_from"), end.cast("date").alias("_wanted_to")]
