from datetime import date

import pytest

from depotflow.operators import experiments as ab

TRIAL = ab.Trial("at_risk_mail", "h", "At Risk", "rate", date(2024, 1, 1), date(2024, 6, 30), 0.4)
CUSTOMERS = "customer_id string, current_rfm_segment string, active_flag boolean"


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], ab.REGISTRY_SCHEMA), spark.createDataFrame([], ab.ASSIGNMENT_SCHEMA)


def test_registration_is_idempotent(empty):
    once = ab.register(empty[0], TRIAL)
    other = ab.register(ab.register(once, TRIAL), ab.Trial("b", "", "Lost", "", date(2024, 1, 1), date(2024, 2, 1)))
    assert sorted((r.test_id, r.test_name) for r in other.collect()) == [(1, "at_risk_mail"), (2, "b")]


def test_assignment_split_and_exclusions(frame, empty):
    registry, none = empty
    people = [(f"c{i:02d}", "At Risk", True) for i in range(21)] + [("lost", "Lost", True), ("gone", "At Risk", False)]
    customers = frame(CUSTOMERS, people)
    busy_test = ab.Trial("other", "", "At Risk", "", date(2024, 6, 30), date(2024, 12, 31), 1.0)
    past_test = ab.Trial("past", "", "At Risk", "", date(2023, 1, 1), date(2023, 12, 31), 1.0)
    registry = ab.register(ab.register(ab.register(registry, TRIAL), busy_test), past_test)
    assigned = ab.assign(frame("customer_id string", [("c00",)]), none, busy_test, date(2024, 1, 1))
    assigned = ab.assign(frame("customer_id string", [("c01",)]), assigned, past_test, date(2023, 1, 1))
    candidates = ab.eligible(customers, registry, assigned, TRIAL)
    assert sorted(r.customer_id for r in candidates.collect()) == [f"c{i:02d}" for i in range(1, 21)]
    done = ab.assign(candidates, assigned, TRIAL, date(2024, 1, 1))
    own = done.filter("test_name = 'at_risk_mail'").collect()
    assert sum(r.test_group == "test" for r in own) == 8 and len(own) == 20  # floor(20 * 0.4)
    assert sorted(r.assignment_id for r in done.collect()) == list(range(1, 23))
    assert ab.eligible(customers, registry, done, TRIAL).count() == 0


def test_outcomes_count_only_orders_inside_the_window(frame, empty):
    people = frame("customer_id string", [("a",), ("b",), ("c",)])
    assigned = ab.assign(people, empty[1], TRIAL, date(2024, 1, 1))
    orders = frame(
        "customer_id string, order_date date, revenue double",
        [
            ("a", date(2023, 12, 1), 5.0), ("a", date(2024, 3, 1), 7.5), ("a", date(2024, 2, 1), 1.5),
            ("b", date(2024, 1, 1), 9.0), ("b", date(2024, 7, 1), 9.0),
        ],
    )
    rows = {r.customer_id: r for r in ab.record_outcomes(assigned, orders, TRIAL.name).collect()}
    assert rows["a"].converted_flag and rows["a"].conversion_date == date(2024, 2, 1) and rows["a"].revenue_post_assignment == 9.0
    assert not rows["b"].converted_flag and rows["b"].conversion_date is None and rows["b"].primary_metric_value == 0.0
    assert not rows["c"].converted_flag


def groups(frame, test, control):
    rows = [("t", "test", i < test[0]) for i in range(test[1])] + [("t", "control", i < control[0]) for i in range(control[1])]
    registry = frame("test_name string, target_segment string", [("t", "At Risk"), ("other", "Lost")])
    return ab.analyse(frame("test_name string, test_group string, converted_flag boolean", rows), registry).first()


def test_analysis(frame):
    good = groups(frame, (30, 60), (12, 60))
    assert good.significant and good.deploy and good.lift_pct == 150.0 and good.recommendation.startswith("adopt for At Risk: +150.0 %")
    bad = groups(frame, (12, 60), (30, 60))
    assert bad.significant and not bad.deploy and bad.lift_pct == -60.0 and bad.recommendation.startswith("reject")
    none = groups(frame, (0, 30), (0, 30))
    assert (none.z_statistic, none.p_value, none.significant, none.lift_pct, none.cohens_h) == (0.0, 1.0, False, 0.0, 0.0)
    alone = groups(frame, (3, 10), (0, 0))
    assert alone.n_control == 0 and alone.z_statistic is None and alone.p_value is None and alone.significant is None
