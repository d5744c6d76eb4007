"""Jobs on a table store: from source files to loaded tables, increments, scores, recommendations and exports.

Each job reads published table versions, writes its result and returns a small status; running one twice adds nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from depotflow import schemas
from depotflow.functions.text import snake_columns, to_boolean
from depotflow.operators import experiments
from depotflow.operators.positions import with_dense_key
from depotflow.operators.profiling import profile_table
from depotflow.operators.versions import (
    after_watermark,
    date_load_status,
    empty_history,
    replace_snapshot,
    utc,
    watermark,
)
from depotflow.plans import checks, customers, forecasting, star, warehouse
from depotflow.session import stage
from depotflow.sources import generated
from depotflow.sources.files import export_csv, read_all, read_csv, with_audit
from depotflow.sources.tables import LoadResult, TableStore, aligned, full_refresh, load_routed, log_steps


class Jobs:
    def __init__(self, spark: SparkSession, store: TableStore, sources: str, run_at: datetime):
        self.spark, self.store, self.sources, self.run_at = spark, store, sources, run_at

    def _csv(self, name: str) -> DataFrame:
        return read_csv(self.spark, f"{self.sources}/{name}.csv")

    def _table(self, name: str) -> DataFrame:
        """Published rows of a table, or none yet."""
        return self.store.read(name, schemas.schema(name))

    def _load(self, name: str, df: DataFrame, source: str) -> LoadResult:
        return full_refresh(self.store, name, with_audit(df, utc(self.run_at), source))

    def _stamped(self, name: str, df: DataFrame) -> DataFrame:
        """Columns and types of the target; audit columns the frame lacks are filled in."""
        wanted = schemas.columns(name)
        extra = {"etl_loaded_at": utc(self.run_at), "etl_source_file": F.lit("computed")}
        missing = {c: v for c, v in extra.items() if c in wanted and c not in df.columns}
        return aligned(df.withColumns(missing) if missing else df, name)

    # -- star schema ---------------------------------------------------------------------------------------

    def load_star(self, sites: DataFrame, first: date, last: date) -> list[LoadResult]:
        """Full refresh: all file contracts are checked first, dimensions load before facts."""
        raw = read_all(self.spark, self.sources, schemas.REQUIRED_COLUMNS)
        calendar = generated.date_dimension(generated.date_range(self.spark, first, last))
        results = [
            self._load("dim_date", calendar, "programmatic"),
            self._load("dim_warehouse", generated.site_dimension(sites), "programmatic"),
            self._load("dim_supplier", star.dim_supplier(raw["suppliers"]), "suppliers.csv"),
            self._load("dim_sku", star.dim_sku(raw["sku_master"]), "sku_master.csv"),
        ]
        demand = star.demand_rows(star.clean_demand(raw["daily_demand"]), *self._dimensions())
        stock = star.fact_inventory_snapshot(raw["inventory_snapshot"], *self._dimensions())
        results.append(self._load("fact_daily_demand", star.fact_daily_demand(demand), "daily_demand.csv"))
        results.append(self._load("fact_inventory_snapshot", stock, "inventory_snapshot.csv"))
        return results

    def _dimensions(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self._table("dim_date"), self._table("dim_sku"), self._table("dim_warehouse")

    def load_new_demand(self, cutoff: date, floor: date = forecasting.FIRST_LOAD_MARK) -> tuple[str, int]:
        """Append demand after the largest loaded date (after `floor` for an empty fact), up to the cutoff."""
        dates, skus, sites = self._dimensions()
        loaded = self._table("fact_daily_demand")
        mark = watermark(dates.join(loaded.agg(F.max("date_key").alias("date_key")), "date_key"), "full_date", floor)
        if mark >= cutoff:
            return date_load_status(mark, cutoff, 0), 0
        fresh = after_watermark(star.clean_demand(self._csv("daily_demand")), "date", mark, cutoff)
        numbered = stage(star.fact_daily_demand(star.demand_rows(fresh, dates, skus, sites), loaded))
        rows = numbered.count()
        if rows:
            audited = with_audit(numbered, utc(self.run_at), "daily_demand.csv since the mark")
            self.store.append("fact_daily_demand", aligned(audited, "fact_daily_demand"))
        return date_load_status(mark, cutoff, rows), rows

    def check_star(self, first: date, last: date) -> DataFrame:
        names = (*checks.DIMENSIONS, *checks.FACTS)
        raw = {"fact_daily_demand": self._csv("daily_demand"), "fact_inventory_snapshot": self._csv("inventory_snapshot")}
        return checks.star_checks({n: self._table(n) for n in names}, raw, first, last)

    # -- forecasting ---------------------------------------------------------------------------------------

    def _active_demand(self) -> DataFrame:
        return forecasting.active_demand(self._table("fact_daily_demand"), *self._dimensions())

    def run_forecast(self, train_from: date, test_from: date, test_to: date, basis_days: int = 61) -> int:
        """All steps of a forecast run, each with a row in the run log, also when it fails; returns the id of the run."""
        run_id = int(self.run_at.timestamp())
        steps: dict[str, Callable[[], tuple[str, int]]] = {
            "features": self.update_features,
            "forecasts": lambda: ("OK", self.forecast(basis_days)),
            "evaluation": lambda: ("OK", self.evaluate(train_from, test_from, test_to)),
            "metrics": lambda: ("OK", self.record_metrics(run_id).count()),
        }
        for step, work in steps.items():
            started = time.perf_counter()
            status, rows, note = "FAILED", 0, ""
            try:
                status, rows = work()
            except Exception as error:
                note = str(error)[:200]
                raise
            finally:
                seconds = round(time.perf_counter() - started, 3)
                log_steps(self.store, [(step, status, rows, seconds, note)], utc(self.run_at), run_id)
        return run_id

    def update_features(self, floor: date = forecasting.FIRST_LOAD_MARK) -> tuple[str, int]:
        """Append features of dates after the largest stored one (after `floor` at first).

        Only demand of those dates is read, next to the state that earlier runs left of each series. Demand that arrives later for a date
        already stored does not change that state.
        """
        stored, demand = self._table("fact_feature_store"), self._active_demand()
        mark = watermark(stored, "feature_date", floor)
        increment = stage(demand.filter(F.col("feature_date") > F.lit(mark)))
        state = self._series_state(demand, mark)
        fresh = stage(with_dense_key(forecasting.features_of_increment(increment, state), "feature_id", None, after=stored))
        rows = fresh.count()
        if rows:
            self.store.append("fact_feature_store", self._stamped("fact_feature_store", fresh))
            upto = watermark(fresh, "feature_date", mark)
            self.store.refresh("series_state", forecasting.advanced_state(state, increment).withColumn("upto", F.lit(upto)))
        return ("OK" if rows else "UP_TO_DATE"), rows

    def _series_state(self, demand: DataFrame, mark: date) -> DataFrame:
        """The stored state, if it ends where the features do; otherwise (first run, or one that broke off) that of the demand up to there."""
        if self.store.exists("series_state"):
            state = self.store.read("series_state")
            if state.agg(F.max("upto")).first()[0] == mark:
                return state.drop("upto")
        return stage(forecasting.demand_state(demand.filter(F.col("feature_date") <= F.lit(mark))))

    def forecast(self, basis_days: int = 61) -> int:
        """Replace the models and the forecasts that start the day after the last demand."""
        self._load("dim_model", generated.model_dimension(self.spark).withColumn("created_at", utc(self.run_at)), "programmatic")
        demand = self._active_demand()
        last = F.lit(watermark(demand, "feature_date", forecasting.FIRST_LOAD_MARK))  # a literal, so that the basis is filtered in the scan
        forecasts = forecasting.baseline_forecasts(demand, F.date_sub(last, basis_days - 1), F.date_add(last, 1))
        _, skus, sites = self._dimensions()
        keyed = forecasts.join(skus.select("sku_id", "sku_key"), "sku_id").join(
            sites.select("warehouse_id", "warehouse_key"), "warehouse_id"
        )
        order = ["sku_id", "warehouse_id", "forecast_horizon_days", "model_id"]
        numbered = with_dense_key(keyed.withColumn("generated_at", utc(self.run_at)), "forecast_id", order)
        return self.store.refresh("fact_forecast", self._stamped("fact_forecast", numbered)).count()

    def evaluate(self, train_from: date, test_from: date, test_to: date) -> int:
        """Replace the holdout errors of all models."""
        errors = forecasting.evaluate(
            self._active_demand(), self._table("fact_feature_store"), F.lit(test_from), F.lit(test_to)
        ).withColumns(
            {
                "evaluation_date": F.lit(self.run_at.date()),
                "train_start": F.lit(train_from),
                "train_end": F.date_sub(F.lit(test_from), 1),
                "test_start": F.lit(test_from),
                "test_end": F.lit(test_to),
                "record_created_at": utc(self.run_at),
            }
        )
        numbered = with_dense_key(errors, "performance_id", ["model_id", "sku_id"])
        return self.store.refresh("fact_model_performance", self._stamped("fact_model_performance", numbered)).count()

    def planner_forecast(self) -> DataFrame:
        skus = self._table("dim_sku")
        best = forecasting.best_models(self._table("fact_model_performance"), skus)
        return forecasting.planner_forecast(self._table("fact_forecast"), best, skus, self._table("dim_model"))

    def record_metrics(self, run_id: int) -> DataFrame:
        """Put this run's mean error and feature rows into the history that drift checks compare; a repeated run replaces its row."""
        mape = F.col("mape").cast("decimal(18,6)")
        row = self._table("fact_model_performance").agg(
            F.lit(run_id).cast("bigint").alias("run_id"),
            F.try_divide(F.sum(mape).cast("double"), F.count(mape).cast("double")).alias("avg_mape"),
            F.count(F.lit(1)).alias("n_evaluations"),
        )
        features = self._table("fact_feature_store").agg(F.count(F.lit(1))).scalar()
        row = row.withColumn("feature_rows", features)
        if self.store.exists("metric_history"):
            row = self.store.read("metric_history").filter(F.col("run_id") != run_id).unionByName(row)
        return self.store.refresh("metric_history", row)

    def check_features(self) -> DataFrame:
        return checks.feature_checks(
            self._table("fact_feature_store"), self._active_demand(), self._table("dim_sku"), self._table("dim_warehouse")
        )

    def check_forecast(self, basis_days: int = 61) -> DataFrame:
        """Checks of the last forecast run against the run log and the metric history."""
        demand = self._active_demand()
        last = demand.agg(F.max("feature_date")).scalar()
        skus = self._table("dim_sku")
        return checks.forecast_checks(
            self._table("run_log"), self._table("fact_forecast"),
            demand.filter(F.col("feature_date") >= F.date_sub(last, basis_days - 1)), skus,
            self.store.read("metric_history"), len(forecasting.MODEL_FORECASTS), forecasting.HORIZON_DAYS,
        )

    def profile(self, table: str, approximate: bool = False) -> DataFrame:
        return profile_table(self._table(table), table, approximate)

    def save_report(self, report: DataFrame, name: str, folder: str) -> None:
        """Append a report to its history and export it as CSV, with the time of the run."""
        timed = report.withColumn("timestamp", utc(self.run_at))
        self.store.append(f"report_{name}", timed)
        export_csv(timed, f"{folder}/{name}")

    # -- customers -----------------------------------------------------------------------------------------

    def load_customers(self) -> DataFrame:
        clean = self._csv("customers").withColumn("ETL_Loaded_At", utc(self.run_at))
        return self.store.refresh("dim_customer", customers.load_customers(self._table("dim_customer"), clean))

    def load_orders(self) -> tuple[str, int]:
        """Append orders of known customers that are not loaded, then bring the lifetime metrics up to date.

        Orders of unknown customers go to `quarantine_fact_orders`; the load log says how many rows took which way.
        """
        started = time.perf_counter()
        clean = customers.clean_orders(self._csv("outbound_orders"), ["order_date", "ship_date", "sku_id", "revenue"])
        routed = customers.route_orders(clean, self._table("dim_customer"), self._table("fact_orders"))
        counts = load_routed(
            self.store, "fact_orders", routed, "order_id", customers.ACCEPTED, customers.REJECTED, lambda df: self._stamped("fact_orders", df)
        )
        rows = counts[customers.ACCEPTED]
        updated = customers.with_lifetime_metrics(self._table("dim_customer"), self._table("fact_orders"))
        self.store.refresh("dim_customer", updated)
        status = "OK" if rows else "UP_TO_DATE"
        note = f"{counts['rows']} delivered, {counts[customers.REJECTED]} of unknown customers"
        log_steps(self.store, [("orders", status, rows, round(time.perf_counter() - started, 3), note)], utc(self.run_at), int(self.run_at.timestamp()), "load_log")
        return status, rows

    def score_customers(self, strict: bool = False) -> DataFrame:
        """Close the current scores, add new ones, and write the segment back to the customers."""
        history = self._table("fact_rfm_scores")
        scores = with_dense_key(
            customers.rfm_scores(self._table("fact_orders"), strict), "score_id", ["customer_id"], after=history
        ).withColumns(
            {"is_current_flag": F.lit(True), "valid_from": utc(self.run_at), "valid_to": F.lit(None).cast("timestamp")}
        )
        snapshot = replace_snapshot(history, self._stamped("fact_rfm_scores", scores), "is_current_flag", utc(self.run_at))
        current = self.store.refresh("fact_rfm_scores", snapshot).filter("is_current_flag")
        self.store.refresh("dim_customer", customers.with_segment(self._table("dim_customer"), current))
        return customers.segment_distribution(current)

    def run_trial(self, trial: experiments.Trial, assigned: date) -> DataFrame:
        """Register, assign, record outcomes, analyse; a repeated run keeps the assignment and refreshes the outcomes."""
        registry = self.store.read("dim_ab_test_registry", experiments.REGISTRY_SCHEMA)
        registry = self.store.refresh("dim_ab_test_registry", experiments.register(registry, trial))
        known = self._table("fact_ab_assignments")
        # segments as of the day of assignment, not today's
        past = self._table("fact_orders").filter(F.col("order_date") <= F.lit(assigned))
        people = customers.with_segment(self._table("dim_customer"), stage(customers.rfm_scores(past)))
        candidates = experiments.eligible(people, registry, known, trial)
        grown = experiments.assign(candidates, known, trial, assigned)
        recorded = experiments.record_outcomes(grown, self._table("fact_orders"), trial.name)
        mine = self.store.refresh("fact_ab_assignments", recorded).filter(F.col("test_name") == trial.name)
        return experiments.analyse(mine, registry)

    def check_customers(self) -> DataFrame:
        return checks.customer_checks(
            self._table("dim_customer"), self._table("fact_rfm_scores"), self._table("fact_ab_assignments")
        )

    # -- warehouse -----------------------------------------------------------------------------------------

    def load_locations(self) -> DataFrame:
        raw = snake_columns(self._csv("warehouse_locations"))
        whole = ("bay", "level", "capacity_units")
        batch = raw.withColumns(
            {c: F.col(c).try_cast("double").try_cast("int") for c in whole}
            | {"active_flag": to_boolean("active_flag"), "etl_loaded_at": utc(self.run_at)}
        )
        history = self.store.read("dim_location", schemas.schema("dim_location")) if self.store.exists("dim_location") else (
            empty_history(batch, "location_surrogate_id")
        )
        return self.store.refresh("dim_location", aligned(warehouse.load_locations(history, batch, utc(self.run_at)), "dim_location"))

    def load_tasks(self) -> tuple[str, int]:
        """Add operators not seen before, then tasks not loaded before."""
        raw = snake_columns(self._csv("wms_tasks"))
        known = self._table("dim_operator")
        grown = warehouse.load_operators(known.drop("etl_loaded_at"), warehouse.clean_tasks(raw))
        stamps = known.select("operator_surrogate_id", "etl_loaded_at")
        operators = grown.join(stamps, "operator_surrogate_id", "left").withColumn(
            "etl_loaded_at", F.coalesce("etl_loaded_at", utc(self.run_at))
        )
        operators = self.store.refresh("dim_operator", aligned(operators, "dim_operator"))
        fresh = stage(warehouse.new_tasks(raw, self._table("fact_wms_tasks"), operators))
        rows = fresh.count()
        if rows:
            self.store.append("fact_wms_tasks", self._stamped("fact_wms_tasks", fresh))
        return ("OK" if rows else "UP_TO_DATE"), rows

    def recommend_slots(self, lookback_days: int = 90) -> DataFrame:
        history = self._table("fact_slotting_history")
        grown = warehouse.recommend(
            self._table("fact_wms_tasks"), self._table("dim_location"), history.drop("etl_loaded_at"), lookback_days
        )
        stamps = history.select("slotting_id", "etl_loaded_at")
        stamped = grown.join(stamps, "slotting_id", "left").withColumn(
            "etl_loaded_at", F.coalesce("etl_loaded_at", utc(self.run_at))
        )
        saved = self.store.refresh("fact_slotting_history", aligned(stamped, "fact_slotting_history"))
        return warehouse.slotting_queue(saved)

    def refresh_pairs(self) -> DataFrame:
        pairs = warehouse.cooccurrence(self._table("fact_wms_tasks")).withColumn("last_calculated_at", utc(self.run_at))
        numbered = with_dense_key(pairs, "pair_id", ["warehouse_id", F.desc("lift_score"), "sku_id_1", "sku_id_2"])
        return self.store.refresh("fact_cooccurrence", aligned(numbered, "fact_cooccurrence"))

    def check_tasks(self, sites: DataFrame | None = None) -> DataFrame:
        """Task checks against the site dimension, or another table with warehouse_id."""
        return checks.task_checks(self._table("fact_wms_tasks"), sites or self._table("dim_warehouse"))

    # -- marts ---------------------------------------------------------------------------------------------

    def marts(self) -> dict[str, DataFrame]:
        """The eight mart views over the published tables."""
        people, scores = self._table("dim_customer"), self._table("fact_rfm_scores")
        tasks = self._table("fact_wms_tasks")
        return {
            "v_customer_segments": customers.customer_segments(people, scores),
            "v_at_risk_customers": customers.customer_list(people, scores, "At Risk", customers.AT_RISK_ACTION),
            "v_champion_customers": customers.customer_list(people, scores, "Champions", customers.CHAMPION_ACTION),
            "v_segment_performance": customers.segment_performance(people, scores, self._table("fact_orders")),
            "v_daily_kpis": warehouse.daily_kpis(tasks),
            "v_operator_scorecard": warehouse.operator_scorecard(tasks, self._table("dim_operator")),
            "v_slotting_queue": warehouse.slotting_queue(self._table("fact_slotting_history")),
            "v_cooccurrence_adjacency": warehouse.adjacency(self._table("fact_cooccurrence")),
        }

    def publish_marts(self, folder: str) -> None:
        """Register the marts as views and export each as CSV in its reading order."""
        orders = {
            "v_at_risk_customers": [F.desc("monetary_value")],
            "v_champion_customers": [F.desc("monetary_value")],
            "v_segment_performance": [F.desc("total_segment_revenue")],
            "v_daily_kpis": ["warehouse_id", F.desc("task_date"), "task_type"],
            "v_operator_scorecard": [F.desc("accuracy_rate_pct")],
            "v_slotting_queue": [F.desc("est_daily_minutes_saved")],
            "v_cooccurrence_adjacency": ["warehouse_id", F.desc("lift_score")],
        }
        for name, df in self.marts().items():
            df.createOrReplaceTempView(name)
            export_csv(df, f"{folder}/{name}", orders.get(name))
