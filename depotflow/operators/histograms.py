"""Value histograms as states that add up: average ranks and quintile edges after a delta, without the rows before it."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window, functions as F

from depotflow.session import stage


def histogram(df: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """(metric, value double, times) of the non-null values; `metrics` maps names to SQL expressions."""
    pairs = ", ".join(f"'{name}', cast({value} as double)" for name, value in metrics.items())
    long = df.selectExpr(f"stack({len(metrics)}, {pairs}) as (metric, value)").filter("value is not null")
    return long.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("times"))


def add_up(*parts: DataFrame) -> DataFrame:
    """Sum of histograms; a part with negative times takes values out. Values that no row has any more vanish."""
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("metric", "value").agg(F.sum("times").alias("times")).filter("times <> 0")


def taken_out(part: DataFrame) -> DataFrame:
    return part.withColumn("times", -F.col("times"))


def ranked(hist: DataFrame) -> DataFrame:
    """(metric, value, first, last, n): first and last 0-based rank of each value and the row count, as `ranked_values` gives them from rows.

    Values are range-partitioned and summed up inside their partition; one number per partition and metric is gathered.
    """
    placed = stage(hist.repartitionByRange("metric", "value").withColumn("_part", F.spark_partition_id()))
    sums = {(r["metric"], r["_part"]): r["times"] for r in placed.groupBy("metric", "_part").agg(F.sum("times").alias("times")).collect()}
    rows = []
    for metric in sorted({m for m, _ in sums}):
        parts = sorted(p for m, p in sums if m == metric)
        counts = [sums[metric, p] for p in parts]
        starts = accumulate(counts, initial=0)
        rows += [(metric, p, s, sum(counts)) for p, s in zip(parts, starts)]
    starts = hist.sparkSession.createDataFrame(rows, "metric string, _part int, _start bigint, n bigint")
    upto = F.sum("times").over(Window.partitionBy("metric", "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("_upto", upto).join(starts, ["metric", "_part"]).select(
        "metric", "value", (F.col("_start") + F.col("_upto") - F.col("times")).alias("first"),
        (F.col("_start") + F.col("_upto") - 1).alias("last"), "n",
    )
