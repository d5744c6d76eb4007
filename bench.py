"""Times the headline queries; prints one JSON line.

Each query runs to completion (all columns, no collection on the driver). "queries" holds the time of the second of two
runs, so that it measures the plan and not the start of the JVM; "first_run" holds the time of the first.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame

from depotflow.catalog import QUERIES, Products, star_report, star_tables
from depotflow.session import build_session, stage

# The steps of a forecast run and of the other products that have published run times.
HEADLINE = [
    "fact_daily_demand", "fact_inventory_snapshot", "star_features", "demand_features", "baseline_forecasts",
    "model_evaluation", "planner_forecast", "incremental_demand", "incremental_orders", "incremental_features",
    "rfm_scores", "segment_performance", "ab_analysis", "daily_kpis", "operator_scorecard", "location_scd2",
    "slotting_recommendations", "cooccurrence_lift", "dq_star", "column_profile",
]


# Stored tables, as a checker finds them: built and written before the clock starts.
STORED = ["dq_star_stored"]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    first_run, seconds = {}, {}
    for times in (first_run, seconds):
        for name in names:
            started = time.perf_counter()
            run(QUERIES[name](spark, folder))
            times[name] = round(time.perf_counter() - started, 3)
    if len(sys.argv) < 2:
        products = Products(spark, folder)
        stored = {n: stage(df) for n, df in star_tables(products).items()}
        sources = {"fact_daily_demand": stage(products.t.demand_source), "fact_inventory_snapshot": stage(products.t.inventory_source)}
        for times in (first_run, seconds):
            started = time.perf_counter()
            run(star_report(stored, sources))
            times["dq_star_stored"] = round(time.perf_counter() - started, 3)
        names = names + STORED
    for name in names:
        print(f"{name}: {first_run[name]} s, then {seconds[name]} s", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first_run,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
