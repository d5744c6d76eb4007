"""Ranks from histograms against ranks from rows; scores after a delta against scores of all orders."""

import random
from datetime import date, timedelta

import pytest
from compare import sorted_rows
from pyspark.sql import functions as F

from depotflow.operators.histograms import add_up, histogram, ranked, taken_out
from depotflow.operators.positions import ranked_values
from depotflow.plans import customers


def test_ranks_are_those_of_the_rows(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") * 7919 % 211).alias("a"),
        F.when(F.col("id") % 10 > 0, (F.col("id") % 17) / 4).alias("b"),
    )
    got, wanted = ranked(histogram(df, {"a": "a", "b": "b"})), ranked_values(df, "id", ["a", "b"])
    assert sorted_rows(got.columns, got.collect()) == sorted_rows(wanted.columns, wanted.collect())


def test_values_come_and_go(frame):
    one = histogram(frame("x int", [(1,), (1,), (2,), (None,)]), {"x": "x"})
    gone = taken_out(histogram(frame("x int", [(2,), (1,)]), {"x": "x"}))
    assert sorted(map(tuple, add_up(one, gone).collect())) == [("x", 1.0, 1)]
    assert ranked(add_up(one, taken_out(one))).count() == 0


def orders(frame, rows):
    return frame("customer_id string, order_date date, revenue double", rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_delta_gives_the_scores_of_all_orders(frame, seed):
    draw = random.Random(seed)
    day = lambda: date(2024, 1, 1) + timedelta(draw.randrange(300))
    early = [(f"c{draw.randrange(60)}", day(), draw.randrange(10**6) / 100) for _ in range(400)]
    early += [("undated", None, 1.0), ("unpaid", day(), None)]
    later = [(f"c{draw.randrange(50, 75)}", date(2024, 11, 5), draw.randrange(10**6) / 100) for _ in range(40)]
    later += [("undated", date(2024, 10, 1), 0.1), ("unpaid", None, 0.2), ("c1", None, None)]
    base, hist = customers.rfm_state(orders(frame, early))
    state = customers.advanced_rfm_state(base, hist, orders(frame, later))
    got, wanted = customers.rfm_scores_of_state(*state), customers.rfm_scores(orders(frame, early + later))
    assert got.dtypes == wanted.dtypes
    assert sorted_rows(got.columns, got.collect()) == sorted_rows(wanted.columns, wanted.collect())
    # the histogram carried on is that of all orders
    full = customers.rfm_state(orders(frame, early + later))[1]
    assert sorted(map(tuple, state[1].collect())) == sorted(map(tuple, full.collect()))


def test_an_empty_delta_and_an_empty_state(frame):
    some = [("a", date(2024, 1, 1), 5.0), ("b", date(2024, 2, 1), 7.0)]
    for early, later in ((some, []), ([], some)):
        state = customers.advanced_rfm_state(*customers.rfm_state(orders(frame, early)), orders(frame, later))
        got, wanted = customers.rfm_scores_of_state(*state), customers.rfm_scores(orders(frame, some))
        assert sorted_rows(got.columns, got.collect()) == sorted_rows(wanted.columns, wanted.collect())
