from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from depotflow.operators import joins, versions
from depotflow.session import stage

LOCATION = "location_id string, zone string, storage_type string, active_flag boolean, capacity int"
TRIGGERS = ["zone", "storage_type", "active_flag"]


def load(history, batch, day):
    at = F.lit(f"2024-01-0{day} 00:00:00")
    return stage(versions.apply_batch(history, batch, "location_id", TRIGGERS, "sid", at))


def test_type_2_history(frame):
    first = frame(LOCATION, [("a", "Z1", "S", True, 1), ("b", None, "S", True, 1), ("c", "Z1", "S", True, 1), ("d", "Z1", "S", True, 1)])
    history = load(versions.empty_history(first, "sid"), first, 1)
    second = frame(
        LOCATION,
        [
            ("a", "Z2", "S", True, 1),  # moved
            ("a", "Z3", "S", True, 1),  # delivered twice: the first in column order counts
            ("b", None, "S", True, 9),  # NULL stays NULL, capacity is no trigger
            ("c", None, "S", True, 1),  # value -> NULL
            ("e", "Z1", "S", False, 1),  # new
            (None, "Z1", "S", True, 1),  # no key
        ],
    )
    history = load(history, second, 2)
    rows = {(r.location_id, r.valid_from.day): r for r in history.collect()}
    assert sorted(rows) == [("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 2), ("d", 1), ("e", 2)]
    assert rows["a", 1].valid_to == datetime(2024, 1, 2) and not rows["a", 1].is_current
    assert rows["a", 2].zone == "Z2" and rows["a", 2].is_current and rows["a", 2].valid_to is None
    assert rows["b", 1].is_current and rows["b", 1].capacity == 1
    assert rows["d", 1].is_current
    assert sorted(r.sid for r in rows.values()) == list(range(1, 8))
    # one current row per key, and a repeated delivery changes nothing
    assert history.filter("is_current").groupBy("location_id").count().filter("count > 1").count() == 0
    again = load(history, second.filter("zone is distinct from 'Z3' and location_id is not null"), 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, history.collect()))


def test_valid_at(frame):
    df = frame("k string, valid_from timestamp, valid_to timestamp", [
        ("old", datetime(2024, 1, 1), datetime(2024, 1, 5)), ("new", datetime(2024, 1, 5), None),
    ])
    at = lambda d: [r.k for r in versions.valid_at(df, F.lit(datetime(2024, 1, d))).collect()]
    assert (at(1), at(4), at(5), at(9)) == (["old"], ["old"], ["new"], ["new"])


def test_snapshot_closes_rows_without_successor(frame):
    ddl = "id string, current boolean, valid_to timestamp"
    history = frame(ddl, [("a", True, None), ("b", True, None), ("c", False, datetime(2023, 1, 1))])
    fresh = frame(ddl, [("a", True, None)])
    rows = versions.replace_snapshot(history, fresh, "current", F.lit("2024-01-01 00:00:00")).collect()
    assert sorted((r.id, r.current) for r in rows) == [("a", False), ("a", True), ("b", False), ("c", False)]
    assert {r.valid_to for r in rows if r.id == "c"} == {datetime(2023, 1, 1)}


def test_upsert_keeps_metrics(frame):
    current = frame("id string, name string, orders bigint", [("a", "old", 7), ("b", "stays", 3)])
    incoming = frame("id string, name string", [("a", None), ("c", "new")])
    rows = versions.upsert(current, incoming, "id", {"orders": F.lit(0).cast("bigint")}).collect()
    assert sorted(map(tuple, rows)) == [("a", None, 7), ("b", "stays", 3), ("c", "new", 0)]


def test_overwrite_columns(frame):
    dim = frame("id string, x int, y int", [("a", 1, 1), ("b", 2, 2)])
    rows = versions.overwrite_columns(dim, frame("id string, y int", [("a", None), ("z", 9)]), "id").collect()
    assert sorted(map(tuple, rows)) == [("a", 1, None), ("b", 2, 2)]


def test_watermark_takes_half_open_range(frame):
    df = frame("d date, x int", [(date(2024, 1, d), d) for d in range(1, 8)])
    assert versions.watermark(df, "d", date(2000, 1, 1)) == date(2024, 1, 7)
    assert versions.watermark(df.limit(0), "d", date(2000, 1, 1)) == date(2000, 1, 1)
    taken = versions.after_watermark(df, "d", date(2024, 1, 2), date(2024, 1, 5))
    assert sorted(r.x for r in taken.collect()) == [3, 4, 5]


@pytest.mark.parametrize(
    "mark, rows, status",
    [(date(2024, 1, 5), 0, "ALREADY_CURRENT"), (date(2024, 1, 4), 0, "NO_NEW_DATA"), (date(2024, 1, 4), 3, "OK")],
)
def test_load_status(mark, rows, status):
    assert versions.date_load_status(mark, date(2024, 1, 5), rows) == status


def test_lookup_and_unmatched(frame):
    fact = frame("k string, v int", [("a", 1), ("x", 2), (None, 3)])
    dim = frame("id string, key int", [("a", 10)])
    df = joins.lookup(fact, dim, {"k": "id"}, ["key"])
    assert sorted(map(tuple, df.collect()), key=repr) == [("a", 1, 10), ("x", 2, None), (None, 3, None)]
    assert joins.unmatched(df, ["key"]).first().key == 2


def test_orphans_and_unknown_differ_on_null(frame):
    df, ref = frame("k string", [("a",), ("x",), (None,)]), frame("k string", [("a",)])
    assert joins.unknown(df, ref, "k").count() == 2
    assert joins.orphans(df, ref, "k").count() == 1
    assert joins.known(df, ref, "k").count() == 1


def test_first_per_key(frame):
    df = frame("k string, t int", [("a", 3), ("a", 1), ("b", 2), ("b", 5)])
    assert sorted(map(tuple, joins.first_per_key(df, ["k"], ["t"]).collect())) == [("a", 1), ("b", 2)]
