"""Late and corrected rows: days of a delivery and of a table are compared by fingerprints, and only the months of unequal days are rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depotflow.session import stage
from depotflow.sources.tables import TableStore

MONTH = "month"  # the partition column, e.g. 199503
NEW, MENDED, KEPT = "new", "mended", "kept"


def month_of(day: str) -> Column:
    return F.year(day) * 100 + F.month(day)


def day_prints(rows: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """(day, rows, a, b) for each day: row count and two sums of row hashes, whatever the order of the rows; repeated rows count.

    Null flags are hashed too, as the hash of a row passes over nulls. Sums combine before the shuffle, which carries one row per task and day.
    """
    told = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    sums = [F.sum(F.xxhash64(F.lit(k), *told).cast("decimal(20,0)")).alias(n) for k, n in enumerate(("a", "b"))]
    return rows.groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("rows"), *sums)


def unequal_days(delivered: DataFrame, held: DataFrame) -> DataFrame:
    """(day, rows_before, rows_after, verdict) of the days whose prints differ; a day the delivery lacks is `kept`."""
    d, h = delivered.alias("d"), held.alias("h")
    both = d.join(h, F.col("d.day").eqNullSafe(F.col("h.day")), "full")
    same = F.lit(True)
    for c in ("rows", "a", "b"):
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"h.{c}"))
    verdict = F.when(F.col("d.rows").isNull(), KEPT).when(F.col("h.rows").isNull(), NEW).otherwise(MENDED)
    return both.filter(~same).select(
        F.coalesce("d.day", "h.day").alias("day"),
        F.coalesce("h.rows", F.lit(0)).cast("bigint").alias("rows_before"),
        F.coalesce("d.rows", F.lit(0)).cast("bigint").alias("rows_after"),
        verdict.alias("verdict"),
    )


def in_months(months: list[int | None]) -> Column:
    """A partition filter; None stands for rows without a day."""
    found = F.col(MONTH).isin([m for m in months if m is not None])
    return found | F.col(MONTH).isNull() if None in months else found


def reconcile(store: TableStore, table: str, delivery: DataFrame, day: str) -> DataFrame:
    """Bring a table partitioned by month in line with a delivery; returns the unequal days, as `unequal_days` does.

    Days of the delivery replace those of the table, whatever changed in them; days it lacks stay. Months without an unequal day are
    not read again and not written. A repeated delivery finds all days equal and changes nothing, and so does one that comes after a
    load that broke off before its commit. Rows without a day count as one day of their own.
    """
    columns = delivery.columns
    placed = delivery.withColumn(MONTH, month_of(day))
    held = store.read(table, placed.schema)
    unequal = stage(unequal_days(day_prints(delivery, day, columns), day_prints(held, day, columns)))
    touched = unequal.filter(F.col("verdict") != KEPT).select(month_of("day").alias(MONTH)).distinct()
    months = [r[MONTH] for r in touched.collect()]  # no more than the calendar has
    if months:
        lost = unequal.filter(F.col("verdict") == KEPT).select(F.col("day").alias("_lost"))
        stay = held.filter(in_months(months)).join(lost, F.col(day).eqNullSafe(F.col("_lost")), "left_semi")
        # staged, as the partitions it reads are overwritten; the hint joins small files and splits large months
        content = stage(placed.filter(in_months(months)).unionByName(stay).hint("rebalance", MONTH))
        store.put(table, content, [MONTH])
    return unequal
