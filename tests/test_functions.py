import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from depotflow.functions import dates, numbers, rules, stats, text


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("SKU_ID", "sku_id"), ("OTIF_Rate", "otif_rate"), ("OTIFRate", "otif_rate"), ("leadTimeDays", "lead_time_days"),
        ("On-Hand Qty", "on_hand_qty"), (" Date ", "date"), ("Weight_KG", "weight_kg"), ("Top10Items", "top10_items"),
    ],
)
def test_snake(name, expected):
    assert text.snake(name) == expected


def test_casts_turn_bad_text_into_null(frame):
    df = frame("x string", [("1.9",), ("-2.9",), ("abc",), (None,), ("",)])
    assert column(df, numbers.to_double("x")) == [1.9, -2.9, None, None, None]
    assert column(df, numbers.to_whole("x")) == [1, -2, None, None, None]
    assert column(df, numbers.to_whole("x", 0)) == [1, -2, 0, 0, 0]


def test_booleans_read_spellings_not_truthiness(frame):
    df = frame("x string", [("False",), ("TRUE",), ("0",), ("y",), ("maybe",), (None,)])
    assert column(df, text.to_boolean("x")) == [False, True, False, True, None, None]


def test_dates_strict_and_lenient(frame):
    df = frame("x string", [("2023-12-31",), ("31/12/23",)])
    assert column(df, dates.lenient_date("x")) == [date(2023, 12, 31), None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        column(df, dates.strict_date("x"))


def test_ratio_needs_a_positive_whole(frame):
    df = frame("a int, b int", [(1, 4), (1, 0), (1, -2), (None, 5)])
    assert column(df, numbers.ratio("a", "b")) == [0.25, None, None, None]


def test_not_below_zero_keeps_null(frame):
    df = frame("x int", [(-3,), (0,), (5,), (None,)])
    assert column(df, numbers.not_below_zero("x")) == [0, 0, 5, None]


def test_rounding_is_binary_and_symmetric(frame):
    df = frame("x double", [(1.005,), (2.5,), (-2.5,), (0.125,), (None,)])
    assert column(df, numbers.rounded("x", 2)) == [1.0, 2.5, -2.5, 0.13, None]
    assert column(df, numbers.rounded("x", 0)) == [1.0, 3.0, -3.0, 0.0, None]


def test_calendar(frame):
    df = frame("d date", [(date(2023, 12, 31),), (date(2022, 1, 1),), (date(2023, 3, 31),)])
    rows = df.select(*[c.alias(n) for n, c in dates.calendar_columns("d").items()]).collect()
    assert [r.date_key for r in rows] == [20231231, 20220101, 20230331]
    assert [r.day_of_week for r in rows] == [7, 6, 5]
    assert [r.week_of_year for r in rows] == [52, 52, 13]
    assert [r.season for r in rows] == ["Winter", "Winter", "Spring"]
    assert [r.is_quarter_end for r in rows] == [True, False, True]
    assert [r.is_month_start for r in rows] == [False, True, False]
    assert column(df, dates.quarter_label("d")) == ["2023-Q4", "2022-Q1", "2023-Q1"]


def segment_by_hand(r, f, m, strict):
    if min(r, f, m) >= 4:
        return "Champions"
    if min(r, f, m) >= 3:
        return "Loyal Customers"
    if r >= 4 and f <= 2:
        return "New Customers"
    if r >= 3 and m >= 2:
        return "Potential Loyalists"
    if strict and r <= 2 and min(f, m) >= 4:
        return "Can't Lose Them"
    if r <= 2 and min(f, m) >= 3:
        return "At Risk"
    if r == f == 1:
        return "Lost"
    if max(r, f, m) <= 2:
        return "Hibernating"
    return "Promising" if r >= 2 and m >= 3 else "Need Attention"


@pytest.mark.parametrize("strict", [False, True])
def test_segments_over_all_scores(frame, strict):
    scores = [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]
    df = frame("r int, f int, m int", scores)
    got = column(df, rules.customer_segment(F.col("r"), F.col("f"), F.col("m"), strict))
    assert got == [segment_by_hand(*s, strict) for s in scores]
    assert ("Can't Lose Them" in got) == strict


def test_slot_target(frame):
    df = frame("v string, z string", [("Hot", "Bulk"), ("Hot", "Pick_Face"), ("Cold", "Pick_Face"), ("Warm", "Bulk"), ("Cold", "Bulk")])
    assert column(df, rules.slot_target(F.col("v"), F.col("z"))) == ["Pick_Face", None, "Reserve", None, None]


def test_zone_by_hash_without_zones(frame):
    df = frame("s string, w string, z array<string>", [("a", "b", None), ("a", "b", []), ("a", "b", ["Bulk"])])
    assert column(df, rules.zone_by_hash(F.col("s"), F.col("w"), F.col("z"))) == ["Reserve", "Reserve", "Bulk"]


def test_anonymous_id(frame):
    import hashlib

    df = frame("x string", [("OP-0001",)])
    assert column(df, text.anonymous_id("x")) == ["OP-" + hashlib.sha256(b"OP-0001").hexdigest()[:8].upper()]


def test_missing_words(frame):
    df = frame("x string", [("nan",), ("None",), ("",), ("E1",), (None,)])
    assert column(df, text.missing_to_null("x")) == [None, None, None, "E1", None]


def test_p_value_close_to_erf(frame):
    zs = [i / 10 for i in range(-60, 61)]
    got = column(frame("z double", [(z,) for z in zs]), stats.two_sided_p(F.col("z")))
    assert all(abs(p - (1 - math.erf(abs(z) / math.sqrt(2)))) < 2e-7 for p, z in zip(got, zs))


def test_two_proportions_edges(frame):
    cases = [(10, 40, 5, 40), (0, 30, 0, 30), (3, 10, 0, 0), (5, 5, 5, 5)]
    df = frame("ca bigint, na bigint, cb bigint, nb bigint", cases)
    parts = stats.two_proportions(F.col("ca"), F.col("na"), F.col("cb"), F.col("nb"))
    rows = df.select(*[c.alias(n) for n, c in parts.items()]).collect()
    pool = 15 / 80
    assert rows[0].z == pytest.approx((0.25 - 0.125) / math.sqrt(pool * (1 - pool) * 2 / 40))
    assert rows[0].lift_pct == pytest.approx(100.0)
    assert rows[0].cohens_h == pytest.approx(2 * math.asin(0.5) - 2 * math.asin(math.sqrt(0.125)))
    assert (rows[1].z, rows[1].lift_pct) == (0.0, 0.0) and rows[1].p_value == pytest.approx(1.0, abs=1e-6)
    assert rows[2].z is None and rows[2].p_value is None and rows[2].lift_pct is None
    assert rows[3].z == 0.0
