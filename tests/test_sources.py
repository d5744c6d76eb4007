from datetime import date

import pytest
from pyspark.sql import functions as F

from depotflow import schemas
from depotflow.operators.versions import utc
from depotflow.plans import star
from depotflow.sources import files, generated, tables
from depotflow.streaming.loads import drain, load_by_date, load_by_key


@pytest.fixture
def store(spark, tmp_path):
    return tables.TableStore(spark, str(tmp_path / "store"))


def test_contract_reports_every_problem(spark, tmp_path):
    (tmp_path / "good.csv").write_text("A,B\n1,2\n")
    (tmp_path / "short.csv").write_text("A\n1\n")
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(files.ContractError) as error:
        files.read_all(spark, str(tmp_path), {f"{n}.csv": ["A", "B"] for n in ("good", "short", "empty", "absent")})
    text = str(error.value)
    assert "short.csv: missing columns ['B']" in text and "empty.csv: file is empty" in text and "absent.csv: file not found" in text
    assert "good.csv" not in text


def test_csv_round_trip(spark, frame, tmp_path):
    out = str(tmp_path / "out")
    files.export_csv(frame("A string, B int", [("x", 1), ("y", 2)]), out, [F.desc("B")])
    back = files.read_csv(spark, out, ["B"])
    assert back.columns == ["B"] and sorted(r.B for r in back.collect()) == ["1", "2"]


def test_star_from_csv_files(spark, store, tmp_path):
    """Text files to a loaded star schema, with dirty values on the way."""
    folder = tmp_path / "in"
    folder.mkdir()
    header = {n: ",".join(c) for n, c in schemas.REQUIRED_COLUMNS.items()}
    lines = {
        "sku_master.csv": ["S2,Cat,A,1.5,bad,1,1,Bulk,P1,7,x,1,1,W1,True", "S1,Cat,B,1,2,1,1,Bulk,P1,7,1,1,1,W1,False"],
        "daily_demand.csv": [
            "2023-01-01,S1,Cat,W1,A,X,10,4,True,", "2023-01-02,S2,Cat,W1,A,X,oops,0,False,5.5", "2023-01-02,S9,Cat,W7,A,X,2,3,False,1",
        ],
        "inventory_snapshot.csv": ["2023-01-31,S1,W1,Cat,0,0,0,0,9", "2023-01-31,S2,W1,Cat,8,0,2,6,x"],
        "suppliers.csv": ["P1,Name,US,Cat,3,n/a,0.9,0.8,0.1,yes"],
        "warehouse_locations.csv": ["L1,W1,Bulk,A1,1,1,10,Bulk,True"],
    }
    for name, rows in lines.items():
        (folder / name).write_text("\n".join([header[name], *rows]) + "\n")
    raw = files.read_all(spark, str(folder), schemas.REQUIRED_COLUMNS)
    dates = generated.date_dimension(generated.date_range(spark))
    sites = generated.site_dimension(spark.createDataFrame([("W1", "Warehouse")], "warehouse_id string, warehouse_name string"))
    skus, suppliers = star.dim_sku(raw["sku_master"]), star.dim_supplier(raw["suppliers"])
    assert [(r.sku_key, r.sku_id, r.unit_price, r.min_order_qty, r.xyz_class) for r in skus.orderBy("sku_key").collect()] == [
        (1, "S1", 2.0, 1, None), (2, "S2", None, None, None),
    ]
    assert suppliers.first().lead_time_std_days is None and suppliers.first().active_flag
    demand = star.fact_daily_demand(star.demand_rows(star.clean_demand(raw["daily_demand"]), dates, skus, sites))
    rows = {r.demand_key: r for r in demand.collect()}
    assert sorted(rows) == [1, 2, 3]
    first = next(r for r in rows.values() if r.date_key == 20230101)
    assert (first.revenue, first.quantity_unfulfilled, first.fill_rate) == (0.0, 6, 0.4)
    oops = next(r for r in rows.values() if r.sku_key == 2)
    assert (oops.quantity_demanded, oops.fill_rate, oops.quantity_unfulfilled) == (0, None, 0)
    stranger = next(r for r in rows.values() if r.sku_key is None)
    assert stranger.warehouse_key is None and stranger.quantity_unfulfilled == 0 and stranger.fill_rate == 1.5
    stock = star.fact_inventory_snapshot(raw["inventory_snapshot"], dates, skus, sites)
    assert {r.on_hand_qty: r.inventory_record_accuracy for r in stock.collect()} == {0: None, 8: 0.75}
    audited = {
        "dim_date": dates, "dim_warehouse": sites, "dim_supplier": suppliers, "dim_sku": skus,
        "fact_daily_demand": demand, "fact_inventory_snapshot": stock,
    }
    audited = {n: files.with_audit(df, F.lit("2024-01-01 00:00:00").cast("timestamp"), f"{n}.csv") for n, df in audited.items()}
    results = tables.load_star(store, audited)
    assert [(r.table, r.status) for r in results] == [(n, "OK") for n in tables.STAR_LOAD_ORDER]
    assert store.read("dim_date").count() == 730
    assert store.read("fact_daily_demand").columns == schemas.columns("fact_daily_demand")
    week = store.read("dim_date").agg(F.max("week_of_year"), F.count_distinct("day_of_year")).first()
    assert week[:] == (52, 365)


def test_versions_never_overwrite_what_is_read(store, frame):
    one = store.refresh("t", frame("x int", [(1,)]))
    two = store.refresh("t", one.unionByName(frame("x int", [(2,)])))  # reads version 1 while writing version 2
    assert sorted(r.x for r in two.collect()) == [1, 2] and [r.x for r in one.collect()] == [1]
    with pytest.raises(Exception):
        store.refresh("t", frame("x int", [(3,)]).select(F.raise_error(F.lit("boom")).cast("int").alias("x")))
    assert sorted(r.x for r in store.read("t").collect()) == [1, 2]
    with pytest.raises(LookupError):
        store.read("absent")


def test_failed_load_reports_an_error(store, frame):
    bad = frame("model_id string", [("x",)]).select(F.raise_error(F.lit("boom")).cast("int").alias("model_id"))
    result = tables.full_refresh(store, "dim_model", bad)
    assert result.status == "ERROR" and result.rows_loaded == 0 and not store.exists("dim_model")


def test_run_log_appends(store):
    from datetime import datetime

    for hour in (1, 2):
        tables.log_steps(store, [("features", "OK", 5, 0.5, ""), ("models", "OK", 7, 0.1, "")], utc(datetime(2024, 1, 1, hour)), hour)
    assert store.read("run_log").count() == 4
    assert store.read("run_log").columns == schemas.columns("run_log")


def test_views(frame, spark):
    tables.publish_view(frame("x int", [(4,)]), "v_numbers")
    assert spark.sql("SELECT sum(x) AS s FROM v_numbers").first().s == 4


def test_model_parameters_are_json(spark):
    models = generated.model_dimension(spark)
    windows = models.select(F.get_json_object("hyperparameters", "$.window")).collect()
    assert [r[0] for r in windows] == ["14", "28", None]


def test_stream_by_key_and_restart(spark, store, frame, tmp_path):
    landing, ddl = str(tmp_path / "landing"), "id string, v int"
    schema = spark.createDataFrame([], ddl).schema
    load = load_by_key(store, "orders", "id", ["v"], ddl)
    frame(ddl, [("a", 1), ("a", 2), ("b", 3)]).coalesce(1).write.parquet(landing)
    drain(spark, landing, schema, load, str(tmp_path / "p1"))
    frame(ddl, [("b", 9), ("c", 4)]).coalesce(1).write.mode("append").parquet(landing)
    drain(spark, landing, schema, load, str(tmp_path / "p1"))
    drain(spark, landing, schema, load, str(tmp_path / "p2"))  # progress lost: all files come again
    assert sorted(map(tuple, store.read("orders").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_stream_by_date_in_many_batches_and_replayed(spark, store, frame, tmp_path):
    """One file per micro-batch: a batch with later dates must not hide the earlier dates of the next."""
    landing, ddl = str(tmp_path / "landing"), "day date, v int"
    schema = spark.createDataFrame([], ddl).schema
    days = [date(2024, 1, 5), date(2024, 1, 3), date(2024, 1, 4)]
    for n, d in enumerate(days):
        frame(ddl, [(d, n)]).coalesce(1).write.mode("append").parquet(landing)
    make = lambda delivery: load_by_date(store, "t", "day", delivery, date(2000, 1, 1), date(2024, 12, 31), ddl)
    drain(spark, landing, schema, make("d1"), str(tmp_path / "p1"), files_per_batch=1)
    drain(spark, landing, schema, make("d1"), str(tmp_path / "p2"), files_per_batch=1)  # the whole delivery again
    assert sorted(r.day for r in store.read("t").collect()) == sorted(days)
    frame(ddl, [(date(2024, 1, 4), 9), (date(2024, 1, 6), 9)]).coalesce(1).write.mode("append").parquet(landing)
    drain(spark, landing, schema, make("d2"), str(tmp_path / "p1"), files_per_batch=1)
    assert sorted(r.day.day for r in store.read("t").collect()) == [3, 4, 5, 6]  # the late 4 January is not loaded


def test_rows_are_routed_in_one_write(spark, frame, tmp_path):
    """Accepted rows go to the table, rejected ones once to the quarantine, and the counts come with the write; also without any rows."""
    from depotflow.plans.customers import ACCEPTED, REJECTED, route_orders
    from depotflow.sources.tables import TableStore, load_routed

    store = TableStore(spark, str(tmp_path))
    people = frame("customer_id string", [("a",), ("a",), (None,)])
    orders = frame("order_id string, customer_id string, x int", [("1", "a", 1), ("2", "b", 2), ("3", None, 3), (None, "a", 4)])
    seen = []
    for delivery in (orders.limit(0), orders, orders):
        routed = route_orders(delivery, people, store.read("orders", orders.schema).filter("order_id is not null"))
        seen.append(load_routed(store, "orders", routed, "order_id", ACCEPTED, REJECTED))
    assert seen[0] == {"rows": 0, ACCEPTED: 0, REJECTED: 0}
    assert seen[1] == {"rows": 4, ACCEPTED: 2, REJECTED: 2} and seen[2] == {"rows": 4, ACCEPTED: 1, REJECTED: 2}
    assert sorted(r.x for r in store.read("orders").collect()) == [1, 4, 4]  # a row without an id is never known as loaded
    assert sorted(r.x for r in store.read("quarantine_orders").collect()) == [2, 3]
