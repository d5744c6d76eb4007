"""Lookups, existence tests and first-row selection.

No join here carries a broadcast hint on data that grows: the optimizer broadcasts a side when its measured size
allows it, and otherwise shuffles and splits hot keys (adaptive skew join; see session.RUNTIME_SETTINGS).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def lookup(fact: DataFrame, dim: DataFrame, on: dict[str, str], take: list[str]) -> DataFrame:
    """Left-join columns of `dim` (unique on its key) onto `fact`; `on` maps fact column -> dim column."""
    renamed = {d: f"_k_{d}" for d in on.values()}
    right = dim.select(*[F.col(d).alias(a) for d, a in renamed.items()], *take)
    condition = [fact[f] == right[renamed[d]] for f, d in on.items()]
    return fact.join(right, condition, "left").drop(*renamed.values())


def unmatched(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: for each looked-up key, how many rows found no partner."""
    return df.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys])


def known(df: DataFrame, reference: DataFrame, key: str, reference_key: str | None = None) -> DataFrame:
    """Rows whose key exists in the reference."""
    keys = reference.select(F.col(reference_key or key).alias(key))
    return df.join(keys, key, "left_semi")


def unknown(df: DataFrame, reference: DataFrame, key: str, reference_key: str | None = None) -> DataFrame:
    """Rows whose key does not exist in the reference; a NULL key counts as unknown."""
    keys = reference.select(F.col(reference_key or key).alias(key))
    return df.join(keys, key, "left_anti")


def orphans(df: DataFrame, reference: DataFrame, key: str, reference_key: str | None = None) -> DataFrame:
    """Like `unknown`, but rows without a key are left out."""
    return unknown(df.filter(F.col(key).isNotNull()), reference, key, reference_key)


def first_per_key(df: DataFrame, keys: list[str], order_by: list[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key. Every task drops all but n rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_nth", F.row_number().over(window)).filter(F.col("_nth") <= n).drop("_nth")
