"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   test tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query, the best counts (default 3)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from measurelake.plans import catalog, oracle  # noqa: E402
from measurelake.session import local_session  # noqa: E402

HEADLINE = [
    "cleaned_rows",
    "cleanup_summary",
    "quality_audit",
    "before_after",
    "problem_counts",
    "problem_example_counts",
    "kpi_metrics",
    "monthly_trends",
    "state_comparison",
    "data_quality_metrics",
    "aqi_distribution",
    "alarm_days",
    "quarterly_trend",
    "worst_days",
    "rolling_average",
    "weekday_analysis",
    "good_air_streaks",
    "zscore_anomalies",
    "anomalies_zscore_rows",
    "anomalies_iqr",
    "site_analysis",
    "forecast_history",
    "linreg_forecast",
    "ma_forecast",
    "seasonal_forecast",
    "forecast_comparison",
]


def timed(action, runs: int) -> float:
    best = float("inf")
    for _ in range(runs):
        start = time.perf_counter()
        action()
        best = min(best, time.perf_counter() - start)
    return round(best, 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "bench", spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()

    def execute(name: str) -> None:
        # The no-op sink takes every row and column without moving them to Python.
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    execute(HEADLINE[0])  # start-up cost is not a query
    seconds = {name: timed(lambda: execute(name), runs) for name in HEADLINE}
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus,
        "best_of": runs,
    }
    if os.environ.get("BENCH_SQL"):
        import duckdb

        con = duckdb.connect(config={"threads": int(cpus) if cpus.isdigit() else 8})
        for path in Path(sf_dir).glob("*.parquet"):
            files = f"{path}/*.parquet" if path.is_dir() else path
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
        sql = oracle.all_sql()
        line["duckdb"] = {
            name: timed(lambda: con.execute(sql[name]).to_arrow_table(), runs) for name in HEADLINE
        }
        line["duckdb_total"] = round(sum(line["duckdb"].values()), 3)
    print(json.dumps(line))


if __name__ == "__main__":
    main()
