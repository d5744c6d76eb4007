from datetime import date, timedelta
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from depotflow.operators.series import demand_features, tail_statistics
from depotflow.plans import forecasting

DDL = "feature_date date, sku_id string, warehouse_id string, abc_class string, quantity_demanded bigint"


def series(spec):
    """spec: {sku: number of rows}; about every third day is missing."""
    rng, rows = random.Random(7), []
    for sku, n in spec.items():
        day = date(2023, 1, 1)
        for _ in range(n):
            rows.append((day, sku, "W", "A", rng.randint(0, 50)))
            day += timedelta(days=rng.choice([1, 1, 2]))
    return rows


def pandas_features(part: pd.DataFrame) -> pd.DataFrame:
    y = part["quantity_demanded"].astype(float)
    out = {f"lag_{n}": y.shift(n).fillna(y.mean()) for n in (1, 7, 14, 28)}
    out |= {f"rolling_avg_{n}": y.shift(1).rolling(n, min_periods=1).mean().fillna(y.mean()) for n in (7, 14, 28)}
    out |= {f"rolling_std_{n}": y.shift(1).rolling(n, min_periods=2).std().fillna(0.0) for n in (7, 14)}
    return pd.DataFrame(out).assign(sku_id=part["sku_id"], feature_date=part["feature_date"])


def test_features_match_pandas(frame):
    rows = series({"one": 1, "two": 2, "three": 3, "short": 20, "long": 90})
    got = demand_features(frame(DDL, rows), ["sku_id", "warehouse_id"], "feature_date", "quantity_demanded")
    got = got.toPandas().sort_values(["sku_id", "feature_date"]).reset_index(drop=True)
    source = pd.DataFrame(rows, columns=[c.split()[0] for c in DDL.split(", ")])
    parts = [pandas_features(g.sort_values("feature_date").reset_index(drop=True)) for _, g in source.groupby("sku_id")]
    want = pd.concat(parts).sort_values(["sku_id", "feature_date"]).reset_index(drop=True)
    columns = [c for c in want if c not in ("sku_id", "feature_date")]
    pd.testing.assert_frame_equal(got[columns], want[columns], check_exact=False, rtol=1e-9, atol=1e-9)


def test_calendar_lag_is_empty_across_a_gap(frame):
    rows = [(date(2023, 1, 1), "a", "W", "A", 10), (date(2023, 1, 3), "a", "W", "A", 20), (date(2023, 1, 4), "a", "W", "A", 60)]
    df = demand_features(frame(DDL, rows), ["sku_id"], "feature_date", "quantity_demanded", calendar=True).orderBy("feature_date")
    assert [r.lag_1 for r in df.collect()] == [30.0, 30.0, 20.0]  # 30 = mean of the series


def test_null_keys_make_no_series(frame):
    rows = [(date(2023, 1, 1), None, "W", "A", 10), (date(2023, 1, 1), "a", "W", "A", 20)]
    assert demand_features(frame(DDL, rows), ["sku_id", "warehouse_id"], "feature_date", "quantity_demanded").count() == 1


@pytest.mark.parametrize("n", [1, 2, 14, 27, 28, 29, 60])
def test_tail_statistics(frame, n):
    rows = series({"s": n})
    y = [float(r[4]) for r in rows]
    got = tail_statistics(frame(DDL, rows), ["sku_id", "warehouse_id"], "feature_date", "quantity_demanded").first()
    mean_14, last14 = sum(y[-14:]) / len(y[-14:]), y[-14:]
    assert got.mean_14 == pytest.approx(mean_14) and got.mean_28 == pytest.approx(sum(y[-28:]) / len(y[-28:]))
    assert got.naive_28 == pytest.approx(y[-28] if n >= 28 else mean_14)
    spread = (sum((v - mean_14) ** 2 for v in last14) / len(last14)) ** 0.5 if n >= 2 else max(0.2 * mean_14, 1.0)
    assert got.spread == pytest.approx(spread)


def test_forecast_rows_and_bounds(frame):
    df = frame(DDL, series({"a": 40, "b": 1}))
    out = forecasting.baseline_forecasts(df, F.lit(date(2023, 1, 1)), F.lit(date(2024, 1, 1)))
    assert out.count() == 2 * 3 * 30
    assert out.filter("lower_bound < 0 or upper_bound < forecasted_qty").count() == 0
    days = out.agg(F.min("forecast_date"), F.max("forecast_date")).first()
    assert days[:] == (date(2024, 1, 1), date(2024, 1, 30))


def test_mape_ignores_zero_actuals(frame):
    rows = [(date(2023, 1, d), "zero", "W", "A", 0) for d in (1, 2)] + [(date(2023, 1, 1), "x", "W", "B", 10)]
    features = frame(
        "sku_id string, warehouse_id string, feature_date date, p double",
        [("zero", "W", date(2023, 1, 1), 2.0), ("zero", "W", date(2023, 1, 2), 4.0), ("x", "W", date(2023, 1, 1), 12.0)],
    )
    day = lambda d: F.lit(date(2023, 1, d))
    out = {r.sku_id: r for r in forecasting.evaluate(frame(DDL, rows), features, day(1), day(9), {7: "p"}).collect()}
    assert out["zero"].mape is None and out["zero"].mae == 3.0 and out["zero"].bias == 3.0
    assert out["x"].mape == 20.0 and out["x"].model_id == 7
    best = forecasting.best_models(
        forecasting.evaluate(frame(DDL, rows), features, day(1), day(9), {7: "p"}), frame("abc_class string", [("A",), ("B",)])
    )
    assert sorted((r.abc_class, r.model_id) for r in best.collect()) == [("A", 1), ("B", 7)]


@pytest.mark.parametrize("cuts", [(date(2023, 3, 1),), (date(2023, 1, 5), date(2023, 1, 6), date(2023, 3, 18))])
def test_features_from_states_equal_those_of_all_rows(frame, cuts):
    """Several increments, also shorter than a look-back; a series that ends early and one that begins late."""
    late = [r for r in series({"c": 80}) if r[0] > date(2023, 2, 20)]
    demand = frame(DDL, series({"a": 80, "b": 75}) + late).cache()
    day, state, begun = F.col("feature_date"), None, None
    for begin, end in zip((date(1900, 1, 1), *cuts), (*cuts, date(2100, 1, 1))):
        part = demand.filter((day > F.lit(begin)) & (day <= F.lit(end)))
        if state is not None:
            got = forecasting.features_of_increment(part, state)
            # the mean that fills gaps is that of the rows known so far
            full = forecasting.feature_store(demand.filter(day <= F.lit(end))).filter(day > F.lit(begin))
            assert got.columns == full.columns and got.exceptAll(full).count() == 0 and got.count() == full.count() == part.count()
        state = forecasting.demand_state(part) if state is None else forecasting.advanced_state(state, part)
    whole = {(r.sku_id, r.warehouse_id): (r.tail, r.total, r.n) for r in forecasting.demand_state(demand).collect()}
    assert {(r.sku_id, r.warehouse_id): (r.tail, r.total, r.n) for r in state.collect()} == whole


def test_the_second_load_reads_no_history(frame, spark, tmp_path):
    demand, day = frame(DDL, series({"a": 80})), F.col("feature_date")
    history, fresh = demand.filter(day <= F.lit(date(2023, 3, 1))), demand.filter(day > F.lit(date(2023, 3, 1)))
    history.write.parquet(f"{tmp_path}/history")
    fresh.write.parquet(f"{tmp_path}/fresh")
    forecasting.demand_state(spark.read.parquet(f"{tmp_path}/history")).write.parquet(f"{tmp_path}/state")
    out = forecasting.features_of_increment(*(spark.read.parquet(f"{tmp_path}/{n}") for n in ("fresh", "state")))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == fresh.count() and "/fresh" in text and "/state" in text and "/history" not in text
