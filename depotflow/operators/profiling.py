"""Column profile and NULL census of a table."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from depotflow.functions.numbers import rounded
from depotflow.operators.bitmaps import distinct_of_words, key_words
from depotflow.session import stage

# Percentages above which a column is flagged.
NULL_FLAG_PCT = 5.0
DUPLICATE_FLAG_PCT = 50.0
EXEMPT_NAME_PARTS = ("key", "flag")


# Integer columns with at most so many possible values for each row are counted in bitmaps, 8 bytes a row at most.
VALUES_FOR_ROW = 64
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def _shown(c: Column, t: T.DataType) -> Column:
    """Numbers with four digits; fractions that these can't show, and NaN and infinities, as they are."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        plain = (c == 0) | F.abs(c).between(1e-4, 1e15)
        return F.when(plain, c.try_cast("decimal(28,4)").cast("string")).otherwise(c.cast("string"))
    return (c.cast("decimal(38,4)") if isinstance(t, T.NumericType) else c).cast("string")


def _as_long(c: Column, t: T.DataType) -> Column:
    return (F.unix_date(c) if isinstance(t, T.DateType) else c).cast("bigint")


def column_state(df: DataFrame, sketches: bool = True) -> DataFrame:
    """One row: row count, and for each column what adds up over parts of a table: filled cells, extremes, sum, and a distinct sketch.

    The sketches cost more than all the rest; only approximate distinct counts need them.
    """
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        aggregates += [F.count(c).alias(f"{f.name}#n"), F.min(c).alias(f"{f.name}#lo"), F.max(c).alias(f"{f.name}#hi")]
        if sketches:
            plain = c if isinstance(f.dataType, (T.StringType, T.IntegerType, T.LongType)) else c.cast("string")
            aggregates.append(F.hll_sketch_agg(plain).alias(f"{f.name}#d"))
        aggregates += [x.alias(f"{f.name}#{n}") for n, x in _sums(c, f.dataType).items()]
    return df.agg(*aggregates)


def _sums(c: Column, t: T.DataType) -> dict[str, Column]:
    """An exact sum to four digits, and a plain one for columns with values (NaN, 1e25) that it can't take."""
    if not isinstance(t, T.NumericType):
        return {}
    exact = c.try_cast("decimal(28,4)")
    return {"sum": F.sum(exact), "off": F.count_if(c.isNotNull() & exact.isNull()), "plain": F.sum(c.cast("double"))}


def merge_column_states(states: DataFrame) -> DataFrame:
    """The state of a table from those of its parts."""
    kinds = {"lo": F.min, "hi": F.max, "d": F.hll_union_agg}
    return states.agg(*[kinds.get(n.rpartition("#")[2], F.sum)(f"`{n}`").alias(n) for n in states.columns])


def distinct_counts(df: DataFrame, extent: Row) -> DataFrame:
    """(column, _distinct): exact numbers of different values, column by column.

    Each count reads one column. Integers and days that lie close together are counted in bitmaps, so what is shuffled are
    buckets of 32,768 neighbouring values; other columns are grouped by value, combined before the shuffle.
    `extent` has the row count and the extremes of each column.
    """
    counts = []
    for f in df.schema.fields:
        c, low, high = F.col(f"`{f.name}`"), extent[f"{f.name}#lo"], extent[f"{f.name}#hi"]
        if isinstance(f.dataType, WHOLE) and low is not None and _width(low, high) <= VALUES_FOR_ROW * extent["_rows"]:
            count = distinct_of_words(key_words(df.select(_as_long(c, f.dataType).alias("v")), "v")).toDF("_distinct")
        else:
            count = df.select(c.alias("v")).filter("v is not null").distinct().agg(F.count(F.lit(1)).alias("_distinct"))
        counts.append(count.select(F.lit(f.name).alias("column"), "_distinct"))
    return reduce(DataFrame.unionAll, counts)


def _width(low: int | date, high: int | date) -> int:
    return (high - low).days if isinstance(low, date) else high - low


def profile_table(df: DataFrame, table: str, approximate: bool = False) -> DataFrame:
    """One row per column: NULLs, distinct values, minimum, maximum, mean and two flags.

    Counts, extremes and means take one pass, whose one row is staged. Distinct counts are exact (`distinct_counts`); `approximate` takes
    them from the sketches of that pass.
    """
    return profile_of_state(df, stage(column_state(df, sketches=approximate)), table, approximate)


def profile_of_state(df: DataFrame, state: DataFrame, table: str, approximate: bool = False) -> DataFrame:
    """The profile from the (merged) state of the table; the rows are only read for exact distinct counts."""
    rows = []
    for f in df.schema.fields:
        filled, numeric = F.col(f"`{f.name}#n`"), isinstance(f.dataType, T.NumericType)
        no_text = F.lit(None).cast("string")
        ordered = numeric or isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        total = F.lit(None).cast("double")
        if numeric:
            total = F.when(F.col(f"`{f.name}#off`") > 0, F.col(f"`{f.name}#plain`")).otherwise(F.col(f"`{f.name}#sum`").cast("double"))
        mean = F.try_divide(total, filled.cast("double"))
        sketched = F.coalesce(F.hll_sketch_estimate(F.col(f"`{f.name}#d`")), F.lit(0)) if approximate else F.lit(0)
        rows.append(
            F.struct(
                F.lit(table).alias("table"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col("_rows").alias("row_count"),
                (F.col("_rows") - filled).alias("null_count"),
                _shown(F.col(f"`{f.name}#lo`"), f.dataType).alias("min"),
                (_shown(F.col(f"`{f.name}#hi`"), f.dataType) if ordered else no_text).alias("max"),
                F.when(F.isnan(mean) | (F.abs(mean) > 1e15), mean).otherwise(rounded(mean, 4)).alias("mean"),
                sketched.cast("bigint").alias("distinct_count"),
            )
        )
    profile = state.select(F.inline(F.array(*rows)))
    if not approximate:
        extent = state.select("_rows", *[f"`{f.name}#{x}`" for f in df.schema.fields for x in ("lo", "hi")]).first()
        profile = profile.drop("distinct_count").join(distinct_counts(df, extent), "column").withColumnRenamed("_distinct", "distinct_count")
    share = F.when(F.col("row_count") > 0, rounded(F.col("null_count") / F.col("row_count") * 100, 4)).otherwise(0.0)
    repeated = F.when(
        F.col("row_count") > 0, rounded((F.lit(1.0) - F.col("distinct_count") / F.col("row_count")) * 100, 4)
    ).otherwise(0.0)
    exempt = F.lit(False)
    for part in EXEMPT_NAME_PARTS:
        exempt = exempt | F.lower("column").contains(part)
    return profile.select(
        "table",
        "column",
        "data_type",
        "row_count",
        "null_count",
        share.alias("null_pct"),
        "distinct_count",
        repeated.alias("duplicate_pct"),
        "min",
        "max",
        "mean",
        (share > NULL_FLAG_PCT).alias("flag_high_nulls"),
        ((F.col("distinct_count") > 0) & (repeated > DUPLICATE_FLAG_PCT) & ~exempt).alias("flag_low_cardinality"),
    )


def null_census(df: DataFrame) -> DataFrame:
    """NULL count and percentage of each column, in one pass."""
    totals = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count")) for c in df.columns]
    return totals.select("_rows", F.inline(F.array(*rows))).select(
        "column",
        "null_count",
        F.when(F.col("_rows") > 0, rounded(F.col("null_count") / F.col("_rows") * 100, 2)).otherwise(0.0).alias("null_pct"),
    )
