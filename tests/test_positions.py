import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from depotflow.operators.positions import quintile_scores, with_dense_key, with_position


def test_positions_cover_the_order(spark):
    df = spark.range(5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("x"))
    got = with_position(df, ["x"]).collect()
    assert sorted((r.position, r.x) for r in got) == [(i, i) for i in range(5000)]


def test_a_hot_value_is_spread_over_partitions(spark):
    """A third of the rows share one leading value; no partition may hold all of them."""
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("x"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = df.repartitionByRange("x", "id").filter("x = 0").groupBy(F.spark_partition_id().alias("p")).count()
        assert max(r["count"] for r in ranged.collect()) < 10000
        got = with_position(df, ["x", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got.select(F.count_distinct("position"), F.max("position")).first()[:] == (30000, 29999)


def test_dense_key_continues(frame):
    first = with_dense_key(frame("id string", [("b",), ("a",)]), "k", ["id"])
    assert sorted(map(tuple, first.collect())) == [(1, "a"), (2, "b")]
    second = with_dense_key(frame("id string", [("d",), ("c",)]), "k", ["id"], after=first)
    assert sorted(map(tuple, second.collect())) == [(3, "c"), (4, "d")]
    assert with_dense_key(frame("id string", []), "k", ["id"], after=first).count() == 0


def test_numbering_without_an_order(spark):
    df = spark.range(1000, numPartitions=5).filter("id % 200 > 30")
    once = with_dense_key(df, "k", None)
    assert once.select(F.min("k"), F.max("k"), F.count_distinct("k")).first()[:] == (1, df.count(), df.count())
    assert "Exchange rangepartitioning" not in once._jdf.queryExecution().executedPlan().toString()


def pandas_scores(values: pd.Series, small_is_good: bool) -> list[int]:
    """Quintiles by pandas, with the average-rank percentile when the edges are not distinct."""
    try:
        cut = pd.qcut(values, 5, labels=False) + 1
        return list(6 - cut if small_is_good else cut)
    except ValueError:
        p = values.rank(pct=True)
        p = 1 - p if small_is_good else p
        return list(pd.cut(p, [-0.001, 0.2, 0.4, 0.6, 0.8, 1.0], labels=False) + 1)


@pytest.mark.parametrize(
    "name, values",
    [
        ("distinct", [float(v) for v in random.Random(1).sample(range(1000), 101)]),
        ("ties", [float(v) for v in random.Random(2).choices(range(12), k=203)]),
        ("hot value", [5.0] * 40 + [float(v) for v in range(60)]),
        ("constant", [3.0] * 17),
        ("tiny", [1.0, 2.0]),
        ("six", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]),
        ("single", [4.0]),
    ],
)
def test_quintiles_match_pandas(spark, name, values):
    df = spark.createDataFrame([(f"c{i:04d}", v, v) for i, v in enumerate(values)], "id string, up double, down double")
    got = quintile_scores(df, "id", {"down": True, "up": False}).orderBy("id").collect()
    series = pd.Series(values)
    assert [r.up_score for r in got] == pandas_scores(series, False)
    assert [r.down_score for r in got] == pandas_scores(series, True)
