"""Global row positions, and the dense keys and exact quantiles that follow from them.

A window without partition keys, or the exact percentile aggregate, would send all rows to one task. Here the
rows are range-partitioned on the full ordering (so equal leading values do not stay together), staged once, and a
row's position is its offset inside its partition plus the rows of all partitions before it. Only one number
per partition is ever gathered.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from depotflow.session import stage

ROWS_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id() counts rows in its low 33 bits


def with_position(df: DataFrame, order_by: list[Column | str] | None, name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in the global order; give an order without ties.

    Without an order the rows are numbered as they lie, which needs no shuffle.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = stage(
        df.withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(ROWS_IN_PARTITION)))
    )
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}  # one number per partition
    starts = list(accumulate((sizes.get(part, 0) for part in range(max(sizes, default=0) + 1)), initial=0))
    start = F.element_at(F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>"), F.col("_part") + 1)
    return placed.withColumn(name, start + F.col("_row")).drop("_part", "_row")


def with_dense_key(
    df: DataFrame, name: str, order_by: list[Column | str] | None, after: DataFrame | None = None
) -> DataFrame:
    """Put a surrogate key start+1..start+n in front, in the given order, if any; start is the largest key in `after`."""
    start = F.lit(0)
    if after is not None:
        start = after.agg(F.coalesce(F.max(name), F.lit(0)).cast("bigint")).scalar()
    numbered = with_position(df, order_by, "_position")
    return numbered.select((start + F.col("_position") + 1).alias(name), *df.columns)


def ranked_values(df: DataFrame, id_column: str, metrics: list[str]) -> DataFrame:
    """One row per (metric, value) with the first and last 0-based rank of that value and the row count `n`."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    long = df.selectExpr(id_column, f"stack({len(metrics)}, {pairs}) as (metric, value)").filter("value is not null")
    placed = with_position(long, ["metric", "value", id_column])
    by_value = placed.groupBy("metric", "value").agg(F.min("position").alias("lo"), F.max("position").alias("hi"))
    by_metric = by_value.groupBy("metric").agg(
        F.min("lo").alias("_base"), (F.max("hi") - F.min("lo") + 1).alias("n")
    )  # one row per metric name
    return by_value.join(F.broadcast(by_metric), "metric").select(
        "metric", "value", (F.col("lo") - F.col("_base")).alias("first"), (F.col("hi") - F.col("_base")).alias("last"), "n"
    )


def fifths(ranked: DataFrame) -> DataFrame:
    """Per metric: what is needed to score a value 1..5 by quintile.

    `edges` are the linearly interpolated 20/40/60/80 % quantiles; `by_edges` says whether minimum, edges and maximum
    all differ. Where they do not, scores come from the average-rank percentile p: `cuts` holds the largest value
    with p <= 0.2 .. 0.8, and `reverse_cuts` the largest value with 1 - p > 0.2 .. 0.8.
    """
    last_rank = F.col("n") - 1
    p = ((F.col("first") + F.col("last")) / 2 + 1) / F.col("n")

    def value_at(rank: Column) -> Column:
        return F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("value")))

    aggregates = [F.min("value").alias("low"), F.max("value").alias("high"), F.max("n").alias("n")]
    for k in range(1, 5):
        below = F.floor(last_rank * k / 5)
        level = F.lit(k / 5)
        aggregates += [
            value_at(below).alias(f"lo{k}"),
            value_at(F.least(below + 1, last_rank)).alias(f"hi{k}"),
            F.max(F.when(p <= level, F.col("value"))).alias(f"cut{k}"),
            F.max(F.when(F.lit(1.0) - p > level, F.col("value"))).alias(f"rev{k}"),
        ]
    summary = ranked.groupBy("metric").agg(*aggregates)
    edges = [
        F.round(F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * F.pmod(last_rank * k, F.lit(5)) / 5, 9)
        for k in range(1, 5)
    ]
    marks = F.array(F.col("low"), *edges, F.col("high"))
    return summary.select(
        "metric",
        F.array(*edges).alias("edges"),
        (F.size(F.array_distinct(marks)) == 6).alias("by_edges"),
        F.array(*[F.col(f"cut{k}") for k in range(1, 5)]).alias("cuts"),
        F.array(*[F.col(f"rev{k}") for k in range(1, 5)]).alias("reverse_cuts"),
    )


def quintile_scores(df: DataFrame, id_column: str, metrics: dict[str, bool], ranks: DataFrame | None = None) -> DataFrame:
    """Add `<metric>_score` in 1..5, 5 best; metrics maps the name to True when small values are good.

    `ranks` of all values, where they are known already, spare sorting the rows.
    """
    marks = fifths(ranked_values(df, id_column, list(metrics)) if ranks is None else ranks)
    table = marks.agg(
        F.map_from_entries(
            F.collect_list(F.struct("metric", F.struct("edges", "by_edges", "cuts", "reverse_cuts")))
        )  # one entry per metric name
    ).scalar()
    scored = df.withColumn("_marks", table)
    for name, small_is_good in metrics.items():
        mark, value = F.col("_marks")[name], F.col(name).cast("double")

        def passed(marks_array: Column) -> Column:
            """How many of the marks lie below the value (a missing mark lies below everything)."""
            return F.size(F.filter(marks_array, lambda m: m.isNull() | (m < value)))

        if small_is_good:
            by_edges = F.lit(5) - passed(mark["edges"])
            by_rank = F.lit(1) + F.size(F.filter(mark["reverse_cuts"], lambda m: m >= value))
        else:
            by_edges = F.lit(1) + passed(mark["edges"])
            by_rank = F.lit(1) + passed(mark["cuts"])
        scored = scored.withColumn(f"{name}_score", F.when(mark["by_edges"], by_edges).otherwise(by_rank))
    return scored.drop("_marks")
