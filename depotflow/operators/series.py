"""Lag and rolling-window features of demand series, and tail statistics.

A series is one (item, site) with at most one row per day, so its length is bounded by the calendar (36,500 rows in a
century) however hot the item is: callers aggregate raw lines to that grain first, with map-side combining.
All columns share one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from depotflow.functions.dates import calendar_features

# Look-backs of the feature store.
LAGS = (1, 7, 14, 28)
MEAN_SPANS = (7, 14, 28)
DEVIATION_SPANS = (7, 14)


def demand_features(
    demand: DataFrame,
    keys: list[str],
    day: str,
    quantity: str,
    calendar: bool = False,
    expanding_fill: bool = False,
) -> DataFrame:
    """Feature columns for each row of each series.

    Look-backs count rows by default, days with `calendar`. Missing history is filled with the mean of the whole
    series, or with the mean of the rows before when `expanding_fill` is set (then NULL on the first row).
    """
    rows = demand.filter(" and ".join(f"{k} is not null" for k in keys))
    y = F.col(quantity).cast("double")
    if expanding_fill:
        fill = F.avg(y).over(Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1))
    else:
        fill = F.avg(y).over(Window.partitionBy(*keys))
    return _filled(rows.select("*", *_looked_back(keys, day, y, calendar), fill.alias("_fill")), rows.columns, day)


def _looked_back(keys: list[str], day: str, y: Column, calendar: bool) -> list[Column]:
    """Lags, means and deviations of the rows before, as `_<feature>`; NULL where there are none."""
    ordered = Window.partitionBy(*keys).orderBy(day)
    by_day = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day)))

    def before(n: int) -> Window:
        return by_day.rangeBetween(-n, -1) if calendar else ordered.rowsBetween(-n, -1)

    def lagged(n: int) -> Column:
        return F.max(y).over(by_day.rangeBetween(-n, -n)) if calendar else F.lag(y, n).over(ordered)

    windowed = {f"lag_{n}": lagged(n) for n in LAGS}
    windowed |= {f"rolling_avg_{n}": F.avg(y).over(before(n)) for n in MEAN_SPANS}
    windowed |= {f"rolling_std_{n}": F.stddev_samp(y).over(before(n)) for n in DEVIATION_SPANS}
    return [c.alias(f"_{n}") for n, c in windowed.items()]


def _filled(raw: DataFrame, columns: list[str], day: str) -> DataFrame:
    names = [f"lag_{n}" for n in LAGS] + [f"rolling_avg_{n}" for n in MEAN_SPANS] + [f"rolling_std_{n}" for n in DEVIATION_SPANS]
    filled = {n: F.coalesce(F.col(f"_{n}"), F.lit(0.0) if n.startswith("rolling_std") else F.col("_fill")) for n in names}
    return raw.select(*columns, *[c.alias(n) for n, c in filled.items()], *[c.alias(n) for n, c in calendar_features(day).items()])


TAIL_ROWS = max(*LAGS, *MEAN_SPANS, *DEVIATION_SPANS)  # no look-back reaches further


def series_state(demand: DataFrame, keys: list[str], day: str, quantity: str) -> DataFrame:
    """What later rows need of a series: (keys, tail: its last 28 (day, y) in order, total, n: sum and count of all its rows)."""
    rows = demand.filter(" and ".join(f"{k} is not null" for k in keys)).select(*keys, F.col(day).alias("day"), F.col(quantity).cast("double").alias("y"))
    newest = Window.partitionBy(*keys).orderBy(F.desc("day"))
    last = rows.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= TAIL_ROWS)
    tails = last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("day", "y"))).alias("tail"))  # at most 28 entries
    totals = rows.groupBy(*keys).agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("total"), F.count("y").alias("n"))
    return tails.join(totals, keys)


def merge_series(states: DataFrame, keys: list[str]) -> DataFrame:
    """One state for each series from the states of several parts; the parts may come in any order."""
    merged = states.groupBy(*keys).agg(
        F.sort_array(F.flatten(F.collect_list("tail"))).alias("_all"), F.sum("total").alias("total"), F.sum("n").alias("n")
    )  # one entry for each part
    tail = F.slice("_all", F.greatest(F.size("_all") - (TAIL_ROWS - 1), F.lit(1)), F.lit(TAIL_ROWS))
    return merged.select(*keys, tail.alias("tail"), "total", "n")


def features_after(increment: DataFrame, state: DataFrame, keys: list[str], day: str, quantity: str, calendar: bool = False) -> DataFrame:
    """Feature columns of the rows of an increment, which all lie after the rows of the state.

    The same values as `demand_features` of all rows: look-backs run over the tails and the increment, missing history is filled with the mean of
    the whole series. Only states of the increment's series are read.
    """
    fresh = increment.filter(" and ".join(f"{k} is not null" for k in keys))
    asked = state.join(fresh.select(*keys).distinct(), keys, "left_semi")
    old = asked.select(*keys, F.inline("tail"), "total", "n").select(
        *keys, F.col("day").alias(day), F.col("y").alias("_y"), F.col("total").alias("_total"), F.col("n").alias("_n"), F.lit(False).alias("_new")
    )
    new = fresh.withColumns({"_y": F.col(quantity).cast("double"), "_new": F.lit(True)})
    rows = new.unionByName(old, allowMissingColumns=True)
    whole = Window.partitionBy(*keys)
    known = F.coalesce(F.max("_total").over(whole), F.lit(0.0)), F.coalesce(F.max("_n").over(whole), F.lit(0))
    added = F.when(F.col("_new"), F.col("_y"))
    fill = F.try_divide(known[0] + F.coalesce(F.sum(added).over(whole), F.lit(0.0)), known[1] + F.count(added).over(whole))
    raw = rows.select(*fresh.columns, "_new", *_looked_back(keys, day, F.col("_y"), calendar), fill.alias("_fill"))
    return _filled(raw.filter("_new"), fresh.columns, day)


def tail_statistics(demand: DataFrame, keys: list[str], day: str, quantity: str) -> DataFrame:
    """Per series: means of its last 14 and 28 rows, the 28th row from the end, spread of the last 14, row count."""
    y = F.col(quantity).cast("double")
    newest_first = Window.partitionBy(*keys).orderBy(F.col(day).desc())
    numbered = demand.select(*keys, y.alias("_y"), F.row_number().over(newest_first).alias("_nth")).filter("_nth <= 28")
    last14 = F.when(F.col("_nth") <= 14, F.col("_y"))
    stats = numbered.groupBy(*keys).agg(
        F.avg(last14).alias("mean_14"),
        F.avg("_y").alias("mean_28"),
        F.max(F.when(F.col("_nth") == 28, F.col("_y"))).alias("row_28"),
        F.stddev_pop(last14).alias("_spread"),
        F.count(F.lit(1)).alias("rows"),
    )
    single = F.greatest(F.col("mean_14") * 0.2, F.lit(1.0))
    return stats.select(
        *keys,
        "mean_14",
        "mean_28",
        F.coalesce("row_28", "mean_14").alias("naive_28"),
        F.when(F.col("rows") >= 2, F.col("_spread")).otherwise(single).alias("spread"),
    )
