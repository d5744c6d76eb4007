"""Named queries over the test tables; each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from depotflow import schemas
from depotflow.bindings import BASIS_DAYS, HOLDOUT_DAYS, TRIAL_END, TRIAL_START, TestTables
from depotflow.operators import experiments
from depotflow.operators.bitmaps import key_state
from depotflow.operators.intervals import as_of
from depotflow.operators.profiling import null_census, profile_table
from depotflow.operators.versions import (
    after_watermark,
    empty_history,
    not_yet_loaded,
    replace_snapshot,
    valid_at,
    watermark,
)
from depotflow.plans import checks, customers, forecasting, star, warehouse
from depotflow.session import shared_folder, stage, tune
from depotflow.sources.generated import date_dimension, model_dimension, site_dimension
from depotflow.sources.files import export_csv, read_all, read_csv, with_audit
from depotflow.sources.keys import KeyedTable
from depotflow.sources.reconcile import reconcile
from depotflow.sources.tables import TableStore, full_refresh, load_routed, log_steps, publish_view
from depotflow.streaming.loads import drain, load_by_bucketed_key, load_by_date, load_by_key

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Products], DataFrame]) -> Callable[[Products], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Products(tune(spark), folder))

    QUERIES[build.__name__] = run
    return build


def once(build: Callable[[Products], DataFrame]) -> Callable[[Products], DataFrame]:
    """Build a shared table only once per query."""

    @wraps(build)
    def cached(p: Products) -> DataFrame:
        if build.__name__ not in p.built:
            p.built[build.__name__] = build(p)
        return p.built[build.__name__]

    return cached


class Products:
    """The tables the queries share, built from the test tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.t = spark, TestTables(spark, folder)
        self.built: dict[str, DataFrame] = {}

    # star schema
    @once
    def dates(self) -> DataFrame:
        return date_dimension(self.t.ship_days)

    @once
    def month_end_dates(self) -> DataFrame:
        """The calendar up to the end of its last month, where the last stock snapshot lies."""
        bounds = self.t.ship_days.select("first", F.last_day("last").alias("last"))
        return date_dimension(bounds)

    @once
    def sites(self) -> DataFrame:
        return site_dimension(self.t.sites)

    @once
    def suppliers(self) -> DataFrame:
        return star.dim_supplier(self.t.supplier_source)

    @once
    def skus(self) -> DataFrame:
        return star.dim_sku(self.t.item_source)

    @once
    def demand_rows(self) -> DataFrame:
        return star.demand_rows(star.clean_demand(self.t.demand_source), self.dates(), self.skus(), self.sites())

    @once
    def demand(self) -> DataFrame:
        return star.fact_daily_demand(self.demand_rows())

    @once
    def inventory(self) -> DataFrame:
        return star.fact_inventory_snapshot(self.t.inventory_source, self.month_end_dates(), self.skus(), self.sites())

    # forecasting
    def last_day(self) -> DataFrame:
        return self.t.ship_days.select("last")

    def forecasts(self) -> DataFrame:
        last = self.last_day().scalar()
        return forecasting.baseline_forecasts(
            self.t.series, F.date_sub(last, BASIS_DAYS - 1), F.date_add(last, 1)
        )

    def performance(self, by_site: bool = False) -> DataFrame:
        last = self.last_day().scalar()
        demand = stage(self.t.series)  # actuals and features both start from the daily series
        return forecasting.evaluate(
            demand, forecasting.feature_store(demand), F.date_sub(last, HOLDOUT_DAYS - 1), last, by_site=by_site
        )

    # customers
    @once
    def orders(self) -> DataFrame:
        """The order table, staged: every customer product reads it more than once."""
        return stage(customers.clean_orders(self.t.order_source, ["order_date"]))

    def customers(self, orders: DataFrame, scores: DataFrame) -> DataFrame:
        empty = self.spark.createDataFrame([], schemas.schema("dim_customer")).drop("etl_loaded_at")
        loaded = customers.load_customers(empty, self.t.customer_source)
        return customers.with_segment(customers.with_lifetime_metrics(loaded, orders), scores)

    def current_scores(self, orders: DataFrame) -> DataFrame:
        return stage(customers.rfm_scores(orders)).withColumn("is_current_flag", F.lit(True))

    @once
    def mart_inputs(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        orders = self.orders()
        scores = self.current_scores(orders)
        return self.customers(orders, scores), scores, orders

    WINBACK = experiments.Trial("winback_trial", "A letter brings back At Risk customers", "At Risk", "conversion_rate", TRIAL_START, TRIAL_END)

    def registry(self) -> DataFrame:
        return experiments.register(self.spark.createDataFrame([], experiments.REGISTRY_SCHEMA), self.WINBACK)

    def trial(self) -> DataFrame:
        """Assignments of the win-back test; segments are as of the day of assignment."""
        test, registry = self.WINBACK, self.registry()
        none = self.spark.createDataFrame([], experiments.ASSIGNMENT_SCHEMA)
        past = self.orders().filter(F.col("order_date") <= F.lit(TRIAL_START))
        known = self.customers(past, stage(customers.rfm_scores(past)))
        return experiments.assign(experiments.eligible(known, registry, none, test), none, test, TRIAL_START)

    def trial_outcomes(self) -> DataFrame:
        return experiments.record_outcomes(self.trial(), self.orders(), self.WINBACK.name)

    # warehouse
    @once
    def operators(self) -> DataFrame:
        empty = self.spark.createDataFrame([], schemas.schema("dim_operator")).drop("etl_loaded_at")
        return warehouse.load_operators(empty, warehouse.clean_tasks(self.t.task_source))

    @once
    def tasks(self) -> DataFrame:
        loaded = self.spark.createDataFrame([], schemas.schema("fact_wms_tasks")).select("task_id")
        return warehouse.new_tasks(self.t.task_source, loaded, self.operators())

    def plain_tasks(self) -> DataFrame:
        """Cleaned tasks for products that do not need the operator dimension."""
        return warehouse.clean_tasks(self.t.task_source)

    @once
    def locations(self) -> DataFrame:
        """Location history after three deliveries."""
        history = empty_history(self.t.location_batch(1), "location_surrogate_id")
        for number in (1, 2, 3):
            loaded_at = F.lit(f"2024-01-0{number} 00:00:00")
            history = stage(warehouse.load_locations(history, self.t.location_batch(number), loaded_at))
        return history

    def no_slotting(self) -> DataFrame:
        return self.spark.createDataFrame([], warehouse.HISTORY)

    def slotting(self) -> DataFrame:
        """History after a run on the month's first half, decisions of two sites on it, and a run on the whole month."""
        tasks, locations = stage(self.plain_tasks()), self.locations()
        early = tasks.filter(F.col("task_date") <= F.lit(date(2024, 1, 15)))
        first = stage(warehouse.recommend(early, locations, self.no_slotting()))
        decisions = first.select(
            "sku_id",
            "warehouse_id",
            F.when(F.col("warehouse_id") == "WH-0", "implemented")
            .when(F.col("warehouse_id") == "WH-1", "rejected")
            .alias("new_status"),
            F.lit(date(2024, 1, 16)).alias("decided_on"),
        ).filter("new_status is not null")
        return warehouse.recommend(tasks, locations, stage(warehouse.decide(first, decisions)))

    def new_store(self) -> TableStore:
        return TableStore(self.spark, f"{shared_folder(self.spark)}/tables-{uuid.uuid4().hex}")


# -- star schema -----------------------------------------------------------------------------------------------


@query
def dim_date(p: Products) -> DataFrame:
    return p.dates()


@query
def dim_warehouse(p: Products) -> DataFrame:
    return p.sites()


@query
def dim_supplier(p: Products) -> DataFrame:
    return p.suppliers()


@query
def csv_suppliers(p: Products) -> DataFrame:
    """Suppliers delivered as a CSV file: contract checked, typed, stamped, loaded twice by full refresh, read back."""
    store = p.new_store()
    required = {"suppliers.csv": schemas.REQUIRED_COLUMNS["suppliers.csv"]}
    export_csv(p.t.supplier_source, f"{store.root}/landing/suppliers.csv")
    delivered = read_all(p.spark, f"{store.root}/landing", required)["suppliers"]
    for _ in range(2):
        loaded = with_audit(star.dim_supplier(delivered), F.current_timestamp(), "suppliers.csv")
        result = full_refresh(store, "dim_supplier", loaded)
    if result.status != "OK":
        raise ValueError(result.message or result.status)
    return store.read("dim_supplier").drop("etl_loaded_at")


@query
def csv_champions(p: Products) -> DataFrame:
    """The champion list as its planners get it: a view, exported in reading order, read back from the CSV files."""
    dim, scores, _ = p.mart_inputs()
    view = publish_view(stage(customers.customer_list(dim, scores, "Champions", customers.CHAMPION_ACTION)), "v_champion_customers")
    store = p.new_store()
    export_csv(p.spark.table("v_champion_customers"), f"{store.root}/champions", [F.desc("monetary_value"), "customer_id"])
    back = read_csv(p.spark, f"{store.root}/champions")
    return back.select(*[F.col(f.name).cast(f.dataType) for f in view.schema])


@query
def run_log_latest(p: Products) -> DataFrame:
    """Steps of the latest run in a log of two runs, the first of which failed."""
    store = p.new_store()
    rows = {name: p.t.table(name).count() for name in ("lineitem", "orders")}
    log_steps(store, [("lineitem", "FAILED", 0, 0.0, "no rows")], F.current_timestamp(), 1)
    log_steps(store, [(name, "OK", n, 0.0, "") for name, n in rows.items()], F.current_timestamp(), 2)
    return checks.latest_run(store.read("run_log")).select("run_id", "step", "status", "rows_processed")


@query
def dim_sku(p: Products) -> DataFrame:
    return p.skus()


@query
def fact_daily_demand(p: Products) -> DataFrame:
    return p.demand()


@query
def fact_inventory_snapshot(p: Products) -> DataFrame:
    return p.inventory()


@query
def star_monthly_revenue(p: Products) -> DataFrame:
    return star.monthly_revenue(p.demand_rows(), p.dates(), p.skus(), p.sites())


@query
def top_stockout_items(p: Products) -> DataFrame:
    return star.top_stockout_items(p.demand_rows(), p.skus())


@query
def monthly_inventory_accuracy(p: Products) -> DataFrame:
    return star.monthly_inventory_accuracy(p.inventory(), p.month_end_dates(), p.sites())


@query
def supplier_two_hop(p: Products) -> DataFrame:
    return star.demand_by_supplier(p.demand_rows(), p.skus(), p.suppliers())


@query
def column_profile(p: Products) -> DataFrame:
    return profile_table(p.demand(), "fact_daily_demand").unionByName(profile_table(p.skus(), "dim_sku"))


@query
def null_counts(p: Products) -> DataFrame:
    return null_census(p.skus())


# -- forecasting -----------------------------------------------------------------------------------------------


@query
def demand_features(p: Products) -> DataFrame:
    return _rounded_features(forecasting.feature_store(p.t.series))


@query
def demand_features_calendar(p: Products) -> DataFrame:
    return _rounded_features(forecasting.feature_store(p.t.series, calendar=True))


@query
def demand_features_expanding(p: Products) -> DataFrame:
    return _rounded_features(forecasting.feature_store(p.t.series, expanding_fill=True))


@query
def star_features(p: Products) -> DataFrame:
    """Feature store at item level, from the star schema."""
    demand = forecasting.active_demand(p.demand_rows(), p.dates(), p.skus(), p.sites())
    return _rounded_features(forecasting.feature_store(demand))


def _rounded_features(df: DataFrame) -> DataFrame:
    """Six digits: the last bits of a deviation depend on the engine."""
    return df.withColumns({c: F.round(c, 6) for c in forecasting.FEATURES})


@query
def baseline_forecasts(p: Products) -> DataFrame:
    return p.forecasts()


@query
def model_evaluation(p: Products) -> DataFrame:
    return p.performance()


@query
def model_evaluation_by_site(p: Products) -> DataFrame:
    return p.performance(by_site=True)


@query
def custom_model_evaluation(p: Products) -> DataFrame:
    """A fourth model, as an expression over the feature columns."""
    last = p.last_day().scalar()
    smoothing = 0.3 * F.col("lag_1") + 0.7 * F.col("rolling_avg_7")
    demand = stage(p.t.series)
    return forecasting.evaluate(
        demand, forecasting.feature_store(demand), F.date_sub(last, HOLDOUT_DAYS - 1), last, {4: smoothing}
    )


@query
def error_by_class(p: Products) -> DataFrame:
    return forecasting.error_by_class(p.performance())


@query
def best_model_per_class(p: Products) -> DataFrame:
    return forecasting.best_models(p.performance(), p.t.series_items)


@query
def planner_forecast(p: Products) -> DataFrame:
    best = forecasting.best_models(p.performance(), p.t.series_items)
    return forecasting.planner_forecast(p.forecasts(), best, p.t.series_items, model_dimension(p.spark))


# -- customers -------------------------------------------------------------------------------------------------


@query
def orders_clean(p: Products) -> DataFrame:
    """Orders from a file with repeated ids and unknown customers."""
    clean = customers.clean_orders(p.t.repeated_order_source, ["ship_date", "sku_id", "warehouse_id", "revenue"])
    loaded = p.spark.createDataFrame([], "order_id string")
    return customers.new_orders(clean, customers.clean_customers(p.t.customer_source), loaded)


@query
def orders_rejected(p: Products) -> DataFrame:
    clean = customers.clean_orders(p.t.repeated_order_source, ["ship_date", "sku_id", "warehouse_id", "revenue"])
    return customers.rejected_orders(clean, customers.clean_customers(p.t.customer_source)).select(
        "order_id", "customer_id", "sku_id", "order_date"
    )


@query
def orders_quarantine(p: Products) -> DataFrame:
    """Orders held back for their unknown customer, after two deliveries of one file; the second adds nothing."""
    store, table = p.new_store(), "fact_orders"
    clean = stage(customers.clean_orders(p.t.repeated_order_source, ["ship_date", "sku_id", "warehouse_id", "revenue"]))
    people = stage(customers.clean_customers(p.t.customer_source))
    for delivery in (clean.filter("order_date < '1998-01-01'"), clean):
        routed = customers.route_orders(delivery, people, store.read(table, clean.schema))
        load_routed(store, table, routed, "order_id", customers.ACCEPTED, customers.REJECTED)
    return store.read(f"quarantine_{table}").select("order_id", "customer_id", "sku_id", "order_date", "verdict")


@query
def fact_orders(p: Products) -> DataFrame:
    return p.orders().drop("warehouse_id")


@query
def customer_lifetime(p: Products) -> DataFrame:
    empty = p.spark.createDataFrame([], schemas.schema("dim_customer")).drop("etl_loaded_at", "current_rfm_segment")
    loaded = customers.load_customers(empty, p.t.customer_source)
    return customers.with_lifetime_metrics(loaded, p.orders())


@query
def rfm_scores(p: Products) -> DataFrame:
    return customers.rfm_scores(p.orders())


@query
def rfm_scores_after_delta(p: Products) -> DataFrame:
    """Scores after later orders, from the state the earlier ones left and the later orders alone."""
    orders, early = p.orders(), F.col("order_date") <= F.lit(FEATURE_CUT)
    base, hist = customers.rfm_state(orders.filter(early))
    return customers.rfm_scores_of_state(*customers.advanced_rfm_state(base, hist, orders.filter(~early | F.col("order_date").isNull())))


@query
def rfm_scores_strict(p: Products) -> DataFrame:
    return customers.rfm_scores(p.orders(), strict=True)


@query
def rfm_segment_distribution(p: Products) -> DataFrame:
    return customers.segment_distribution(customers.rfm_scores(p.orders()))


@query
def rfm_history(p: Products) -> DataFrame:
    """Score history after two runs, on the orders up to mid 2000 and on all orders."""
    return _score_history(p)


@query
def rfm_at_date(p: Products) -> DataFrame:
    """Scores that were valid between the two runs."""
    return valid_at(_score_history(p), F.lit("2000-12-01 00:00:00").cast("timestamp")).drop("valid_to", "is_current_flag")


def _score_history(p: Products) -> DataFrame:
    orders = p.orders()
    columns = ["customer_id", "scoring_date", "rfm_segment", "is_current_flag", "valid_from", "valid_to"]

    def run(part: DataFrame, at: str) -> DataFrame:
        return customers.rfm_scores(part).select(
            *columns[:3], F.lit(True).alias("is_current_flag"), F.lit(at).cast("timestamp").alias("valid_from"),
            F.lit(None).cast("timestamp").alias("valid_to"),
        )

    first = run(orders.filter(F.col("order_date") <= F.lit(date(2000, 6, 30))), "2000-07-01 00:00:00")
    second_at = "2001-09-01 00:00:00"
    return replace_snapshot(first, run(orders, second_at), "is_current_flag", F.lit(second_at))


@query
def orders_with_score(p: Products) -> DataFrame:
    """Every order with the segment its customer had on the day of the order; none before the first scoring."""
    orders = p.orders().select("order_id", "customer_id", "order_date")
    return as_of(orders, stage(_score_history(p)), "customer_id", "order_date", ["rfm_segment", "scoring_date"])


@query
def customer_segments(p: Products) -> DataFrame:
    dim, scores, _ = p.mart_inputs()
    return customers.customer_segments(dim, scores)


@query
def at_risk_customers(p: Products) -> DataFrame:
    dim, scores, _ = p.mart_inputs()
    return customers.customer_list(dim, scores, "At Risk", customers.AT_RISK_ACTION)


@query
def champion_customers(p: Products) -> DataFrame:
    dim, scores, _ = p.mart_inputs()
    return customers.customer_list(dim, scores, "Champions", customers.CHAMPION_ACTION)


@query
def segment_performance(p: Products) -> DataFrame:
    return customers.segment_performance(*p.mart_inputs())


@query
def ab_assignment(p: Products) -> DataFrame:
    return p.trial().select("assignment_id", "customer_id", "test_name", "test_group", "assigned_at", "test_end_date")


@query
def ab_assignment_with_history(p: Products) -> DataFrame:
    """The same test after two earlier ones: customers of the one that still runs are left out, those of the one that ended are not."""
    spring = experiments.Trial("spring_trial", "A call brings back At Risk customers", "At Risk", "conversion_rate", date(2000, 2, 1), date(2000, 7, 31))
    summer = experiments.Trial("summer_trial", "A coupon brings back At Risk customers", "At Risk", "conversion_rate", date(2000, 6, 15), date(2000, 9, 15))
    registry = experiments.register(experiments.register(p.registry(), spring), summer)
    number = F.substring("Customer_ID", 6, 12).cast("bigint")

    def earlier(trial: experiments.Trial, every: int, at: int) -> DataFrame:
        return p.t.customer_source.filter(number % every == 0).select(
            (number * 2 + at).alias("assignment_id"), F.col("Customer_ID").alias("customer_id"), F.lit(trial.name).alias("test_name"),
            F.when(number % 2 == 0, "test").otherwise("control").alias("test_group"), F.lit(trial.starts).alias("assigned_at"),
            F.lit(trial.starts).alias("test_start_date"), F.lit(trial.ends).alias("test_end_date"), F.lit(None).cast("double").alias("primary_metric_value"),
            F.lit(False).alias("converted_flag"), F.lit(None).cast("date").alias("conversion_date"), F.lit(0.0).alias("revenue_post_assignment"),
        )

    known = stage(earlier(spring, 5, 0).unionByName(earlier(summer, 3, 1)))
    past = p.orders().filter(F.col("order_date") <= F.lit(TRIAL_START))
    people = p.customers(past, stage(customers.rfm_scores(past)))
    grown = experiments.assign(experiments.eligible(people, registry, known, p.WINBACK), known, p.WINBACK, TRIAL_START)
    return grown.select("assignment_id", "customer_id", "test_name", "test_group", "assigned_at", "test_end_date")


@query
def ab_outcomes(p: Products) -> DataFrame:
    return p.trial_outcomes().select(
        "assignment_id", "customer_id", "test_group", "converted_flag", "conversion_date",
        "revenue_post_assignment", "primary_metric_value",
    )


@query
def ab_analysis(p: Products) -> DataFrame:
    return experiments.analyse(p.trial_outcomes(), p.registry())


# -- warehouse -------------------------------------------------------------------------------------------------


@query
def wms_tasks(p: Products) -> DataFrame:
    return p.tasks()


@query
def operator_dim(p: Products) -> DataFrame:
    return p.operators()


@query
def daily_kpis(p: Products) -> DataFrame:
    return warehouse.daily_kpis(p.plain_tasks())


@query
def operator_scorecard(p: Products) -> DataFrame:
    return warehouse.operator_scorecard(p.tasks(), p.operators())


@query
def location_scd2(p: Products) -> DataFrame:
    return p.locations()


@query
def locations_at_date(p: Products) -> DataFrame:
    """Locations as they were on 2 January, after the second delivery."""
    return valid_at(p.locations(), F.lit("2024-01-02 12:00:00").cast("timestamp")).select(
        "location_id", "warehouse_id", "zone", "storage_type", "active_flag", "capacity_units"
    )


@query
def tasks_with_location(p: Products) -> DataFrame:
    """Every task with zone and capacity that the storage location of its item had on that day."""
    place = F.concat(F.lit("LOC-"), F.substring("sku_id", 5, 12))
    tasks = p.plain_tasks().select("task_id", "task_date", place.alias("location_id"))
    return as_of(tasks, p.locations(), "location_id", "task_date", ["zone", "capacity_units", "active_flag"], days=8)


@query
def sku_velocity(p: Products) -> DataFrame:
    return warehouse.sku_velocity(p.plain_tasks())


@query
def slotting_recommendations(p: Products) -> DataFrame:
    return p.slotting()


@query
def slotting_queue(p: Products) -> DataFrame:
    return warehouse.slotting_queue(warehouse.recommend(p.plain_tasks(), p.locations(), p.no_slotting()))


@query
def realised_savings(p: Products) -> DataFrame:
    return warehouse.realised_savings(p.slotting(), p.plain_tasks())


@query
def cooccurrence_lift(p: Products) -> DataFrame:
    return warehouse.cooccurrence(p.plain_tasks())


@query
def adjacency_top(p: Products) -> DataFrame:
    return warehouse.adjacency(warehouse.cooccurrence(p.plain_tasks()))


FEATURE_CUT = date(2000, 6, 30)  # end of the first of two deliveries


# -- increments ------------------------------------------------------------------------------------------------


@query
def incremental_demand(p: Products) -> DataFrame:
    """Demand loaded in three steps by date watermark, appended to a table."""
    store, table = p.new_store(), "daily_demand"
    source = stage(star.clean_demand(p.t.demand_source)).drop("category")
    last = source.agg(F.max("date")).first()[0]
    for cutoff in (date(1998, 12, 31), date(2000, 6, 30), last, last):
        mark = watermark(store.read(table, source.schema), "date", date(1900, 1, 1))
        if mark < cutoff:
            store.append(table, after_watermark(source, "date", mark, cutoff))
    return store.read(table)


def _reconciled(p: Products) -> tuple[TableStore, DataFrame]:
    """Demand delivered twice: at first up to a day, without late rows of one site and with quantities that are corrected later."""
    store, day = p.new_store(), F.col("date")
    source = stage(star.clean_demand(p.t.demand_source).drop("category"))
    late = (F.col("warehouse_id") == "EUROPE") & (F.dayofmonth(day) == 15)
    wrong = (F.month(day) == 3) & (F.dayofmonth(day) == 20)
    before = F.when(wrong, F.col("quantity_demanded") + 1).otherwise(F.col("quantity_demanded")).cast(source.schema["quantity_demanded"].dataType)
    reconcile(store, "daily_demand", source.filter((day <= F.lit(FEATURE_CUT)) & ~late).withColumn("quantity_demanded", before), "date")
    return store, reconcile(store, "daily_demand", source, "date")


@query
def reconciled_demand(p: Products) -> DataFrame:
    """Demand after a second delivery that brings new days, late rows and corrections of old days."""
    return _reconciled(p)[0].read("daily_demand").drop("month")


@query
def reconciled_days(p: Products) -> DataFrame:
    """The days that the second delivery brought or mended."""
    return _reconciled(p)[1]


@query
def incremental_orders(p: Products) -> DataFrame:
    """Orders loaded in overlapping deliveries by key difference, appended to a table."""
    store, table = p.new_store(), "fact_orders"
    orders = p.orders().drop("warehouse_id")
    day = F.col("order_date")
    early, middle, late = day < F.lit(date(1997, 1, 1)), day.between(F.lit(date(1996, 1, 1)), F.lit(date(2000, 1, 1))), day.isNotNull()
    for delivered in (middle, early, late, late):  # the second delivery is older than the first, the last brings nothing
        store.append(table, not_yet_loaded(orders.filter(delivered), store.read(table, orders.schema), "order_id"))
    return store.read(table)


@query
def incremental_features(p: Products) -> DataFrame:
    """Feature store filled in two steps; the second reads its own days and the state the first one left of each series."""
    demand = stage(p.t.series)  # both deliveries
    first, second = (demand.filter(day) for day in (F.col("feature_date") <= F.lit(FEATURE_CUT), F.col("feature_date") > F.lit(FEATURE_CUT)))
    state = stage(forecasting.demand_state(first))
    return _rounded_features(forecasting.feature_store(first).unionByName(forecasting.features_of_increment(second, state)))


@query
def streamed_orders(p: Products) -> DataFrame:
    """The order table through a file stream, keyed like the batch load."""
    store, table = p.new_store(), "orders"
    schema = p.t.table("orders").schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    load = load_by_key(store, table, "o_orderkey", ["o_orderdate", "o_custkey"], ddl)
    for attempt in ("first", "second"):  # a second stream that sees the files again adds nothing
        drain(p.spark, p.t.folder, schema, load, f"{store.root}/progress-{attempt}", "orders.parquet")
    return store.read(table).withColumn("o_orderdate", F.to_date("o_orderdate"))


@query
def streamed_orders_by_bucket(p: Products) -> DataFrame:
    """The order table through two file streams into key buckets; the second stream sees the files again and adds nothing."""
    schema = p.t.table("orders").schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    table = KeyedTable(p.new_store(), "orders", "o_orderkey", ddl, buckets=16)
    for attempt in ("first", "second"):
        load = load_by_bucketed_key(table, ["o_orderdate", "o_custkey"])
        drain(p.spark, p.t.folder, schema, load, f"{table.store.root}/progress-{attempt}", "orders.parquet")
    return table.read().withColumn("o_orderdate", F.to_date("o_orderdate"))


@query
def streamed_lines(p: Products) -> DataFrame:
    """Line items through a file stream with a date watermark, in two steps."""
    store, table = p.new_store(), "lines"
    schema = p.t.table("lineitem").schema
    ddl = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, day date"
    slim = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.to_date("l_shipdate").alias("day")]
    for delivery, cutoff in (("first", date(1999, 12, 31)), ("second", date(2100, 1, 1))):
        load = load_by_date(store, table, "day", delivery, date(1900, 1, 1), cutoff, ddl)
        drain(
            p.spark, p.t.folder, schema, lambda batch, n, load=load: load(batch.select(*slim), n),
            f"{store.root}/progress-{delivery}", "lineitem.parquet",
        )
    return store.read(table).drop("delivery", "batch")


@query
def metric_drift(p: Products) -> DataFrame:
    """Error and feature growth over three forecast runs that end a year apart."""
    return checks.metric_drift(_metric_history(p))


def _metric_history(p: Products) -> DataFrame:
    demand = stage(p.t.series)
    history = None
    last = p.last_day()
    for run in range(3):
        end = F.add_months(last.scalar(), -12 * (2 - run))
        known = demand.filter(F.col("feature_date") <= end)
        features = forecasting.feature_store(known)
        errors = forecasting.evaluate(known, features, F.date_sub(end, HOLDOUT_DAYS - 1), end)
        mape = F.col("mape").cast("decimal(18,6)")
        row = errors.agg(
            F.lit(run + 1).cast("bigint").alias("run_id"),
            F.try_divide(F.sum(mape).cast("double"), F.count(mape).cast("double")).alias("avg_mape"),
            F.count(F.lit(1)).alias("n_evaluations"),
        ).withColumn("feature_rows", known.agg(F.count(F.lit(1))).scalar())
        history = row if history is None else history.unionByName(row)
    return history


# -- data checks -----------------------------------------------------------------------------------------------


def star_tables(p: Products) -> dict[str, DataFrame]:
    return {
        "dim_date": p.month_end_dates(), "dim_warehouse": p.sites(), "dim_supplier": p.suppliers(), "dim_sku": p.skus(),
        "fact_daily_demand": p.demand(), "fact_inventory_snapshot": p.inventory(),
    }


def star_report(tables: dict[str, DataFrame], sources: dict[str, DataFrame]) -> DataFrame:
    return checks.star_checks(tables, sources, date(1995, 1, 1), date(2001, 6, 30))


@query
def dq_star(p: Products) -> DataFrame:
    # the raw rows stand in for source files, which the load and the completeness check both read
    p.t.demand_source, p.t.inventory_source = stage(p.t.demand_source), stage(p.t.inventory_source)
    return star_report(star_tables(p), {"fact_daily_demand": p.t.demand_source, "fact_inventory_snapshot": p.t.inventory_source})


@query
def dq_demand_by_load(p: Products) -> DataFrame:
    """Checks of the demand fact from the states that two loads left, merged; and its repeated keys, over both loads."""
    first, last = date(1995, 1, 1), date(2001, 6, 30)
    store, table, key = p.new_store(), "fact_daily_demand", "demand_key"
    fact = p.demand()
    dims = {"dim_date": p.month_end_dates(), "dim_sku": p.skus(), "dim_warehouse": p.sites()}
    states = {d: stage(key_state(df, checks.DIMENSIONS[d])) for d, df in dims.items()}
    for number, load in enumerate((fact.filter("date_key < 19980101"), fact.filter("date_key >= 19980101")), 1):
        state = checks.fact_state(table, load, states, dims["dim_date"], first, last)
        store.append("check_states", state.withColumn("load", F.lit(number)), ["load"])
    merged = stage(checks.merge_fact_states(table, store.read("check_states"), first, last))
    source = p.t.demand_source
    parts = [checks.fact_report(table, merged, source, first, last), checks.duplicate_check(table, key, fact, merged)]
    return checks.with_failure_pct(checks.report(parts))


@query
def dq_features(p: Products) -> DataFrame:
    demand = stage(p.t.series)
    return checks.feature_checks(forecasting.feature_store(demand), demand, p.t.series_items, p.t.sites)


@query
def dq_monitor(p: Products) -> DataFrame:
    """Checks of a run whose log is the metric history itself: one step per run."""
    history = stage(_metric_history(p))
    log = history.select(
        F.concat(F.lit("evaluation "), F.col("run_id").cast("string")).alias("step"),
        F.when(F.col("n_evaluations") > 0, "OK").otherwise("NO_NEW_DATA").alias("status"),
    )
    last = p.last_day().scalar()
    basis = p.t.series.filter(F.col("feature_date") >= F.date_sub(last, BASIS_DAYS - 1))
    return checks.forecast_checks(
        log, p.forecasts(), basis, p.t.series_items, history, len(forecasting.MODEL_FORECASTS), forecasting.HORIZON_DAYS
    )


@query
def dq_customers(p: Products) -> DataFrame:
    dim, scores, _ = p.mart_inputs()
    return checks.customer_checks(dim, scores, p.trial_outcomes())


@query
def dq_wms(p: Products) -> DataFrame:
    tasks = stage(p.tasks())
    return checks.task_checks(tasks, p.t.task_sites)
