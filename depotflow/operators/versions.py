"""Versioned dimensions, upserts and increments, built from joins (Parquet tables know no MERGE)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from depotflow.operators.joins import first_per_key, unknown
from depotflow.operators.positions import with_dense_key

OPEN_COLUMNS = {"valid_from": "timestamp", "valid_to": "timestamp", "is_current": "boolean"}


def apply_batch(
    history: DataFrame,
    batch: DataFrame,
    key: str,
    triggers: list[str],
    surrogate: str,
    loaded_at: Column,
    batch_order: list[Column | str] | None = None,
) -> DataFrame:
    """Next state of a type-2 dimension.

    New key: insert. A trigger column differs (NULL-safe): close the current row and insert. Anything else, and keys
    missing from the batch, stay as they are. A key delivered twice in one batch counts once (first by `batch_order`).
    """
    attributes = [c for c in history.columns if c not in (surrogate, *OPEN_COLUMNS)]
    staged = first_per_key(batch.filter(F.col(key).isNotNull()), [key], batch_order or attributes)
    current = history.filter("is_current").select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_old_{c}") for c in triggers], F.lit(True).alias("_known")
    )
    compared = staged.select(*attributes).join(current, F.col(key) == F.col("_key"), "left")
    changed = F.lit(False)
    for c in triggers:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    entering = compared.filter(F.col("_known").isNull() | changed).select(*attributes)
    opened = with_dense_key(entering, surrogate, [key], after=history).select(
        "*",
        loaded_at.cast("timestamp").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"),
        F.lit(True).alias("is_current"),
    )
    replaced = opened.select(F.col(key).alias("_key"), F.lit(True).alias("_replaced"))
    closes = F.col("is_current") & F.coalesce(F.col("_replaced"), F.lit(False))
    closed = history.join(replaced, F.col(key) == F.col("_key"), "left").select(
        *[c for c in history.columns if c not in ("valid_to", "is_current")],
        F.when(closes, loaded_at.cast("timestamp")).otherwise(F.col("valid_to")).alias("valid_to"),
        (F.col("is_current") & ~closes).alias("is_current"),
    )
    return closed.select(*history.columns).unionByName(opened.select(*history.columns))


def empty_history(batch: DataFrame, surrogate: str) -> DataFrame:
    """A type-2 table without rows, with the attributes of `batch`."""
    extra = [F.lit(None).cast(t).alias(c) for c, t in OPEN_COLUMNS.items()]
    return batch.select(F.lit(None).cast("bigint").alias(surrogate), "*", *extra).filter(F.lit(False))


def replace_snapshot(history: DataFrame, fresh: DataFrame, flag: str, closed_at: Column) -> DataFrame:
    """Close every current row, also those that get no successor, and add the fresh rows."""
    closed = history.withColumns(
        {
            "valid_to": F.when(F.col(flag), closed_at.cast("timestamp")).otherwise(F.col("valid_to")),
            flag: F.lit(False),
        }
    )
    return closed.unionByName(fresh.select(*history.columns))


def valid_at(history: DataFrame, moment: Column) -> DataFrame:
    """Rows of a type-2 table that were valid at the given moment (a literal, or a column of a joined fact)."""
    return history.filter(
        (F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment))
    )


def upsert(current: DataFrame, incoming: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Type-1 upsert: incoming attributes win, columns only `current` has are kept, new keys get `defaults`."""
    old = current.withColumn("_old", F.lit(True)).alias("old")
    new = incoming.withColumn("_new", F.lit(True)).alias("new")

    def merged(c: str) -> Column:
        if c == key:
            return F.col(key)
        if c in incoming.columns:
            return F.when(F.col("_new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
        return F.when(F.col("_old"), F.col(f"old.{c}")).otherwise(defaults.get(c, F.lit(None))).alias(c)

    return old.join(new, key, "full").select(*[merged(c) for c in current.columns])


def overwrite_columns(dim: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """Replace the columns `computed` brings where it has a row for the key; keep the old values elsewhere."""
    values = [c for c in computed.columns if c != key]
    fresh = computed.select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_hit")
    )

    def chosen(c: str) -> Column:
        if c not in values:
            return F.col(c)
        return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    return dim.join(fresh, F.col(key) == F.col("_key"), "left").select(*[chosen(c) for c in dim.columns])


def watermark(df: DataFrame, column: str, floor: date) -> date:
    """Largest date already loaded (one value), or `floor` for an empty table."""
    return df.agg(F.max(column)).first()[0] or floor


def after_watermark(source: DataFrame, column: str, mark: date, cutoff: date) -> DataFrame:
    """mark < date <= cutoff, with literals that reach the file scan. Rows that arrive late are not loaded."""
    return source.filter((F.col(column) > F.lit(mark)) & (F.col(column) <= F.lit(cutoff)))


def date_load_status(mark: date, cutoff: date, new_rows: int) -> str:
    """Status word of a date-watermark load."""
    if mark >= cutoff:
        return "ALREADY_CURRENT"
    return "OK" if new_rows else "NO_NEW_DATA"


def not_yet_loaded(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target does not hold; late rows are kept."""
    return unknown(source, target, key)


def utc(moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
