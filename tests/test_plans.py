"""What the optimizer makes of the queries."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from measurelake.functions.quantiles import exact_quantiles
from measurelake.model import FilterState
from measurelake.operators import anomalies, audit, cleanup, filters, series, summary
from measurelake.plans import catalog

SF = "/root/testdata/sf0.001"
WRITING = {"src_csv_roundtrip", "sink_parquet_roundtrip", "sink_csv_roundtrip", "sink_explorer_csv"}


def plan(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.fixture()
def table(spark, raw, tmp_path):
    raw({}).write.parquet(str(tmp_path / "raw"))
    return spark.read.parquet(str(tmp_path / "raw"))


def test_filter_and_columns_reach_the_scan(table):
    selection = FilterState(("A", "B"), date(2024, 1, 1), date(2024, 3, 31))
    text = plan(summary.state_comparison(cleanup.clean(table), selection))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "In(state_name, [A,B])" in pushed
    assert "GreaterThanOrEqual(date_local,2024-01-01)" in pushed
    read = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert set(re.findall(r"(\w+):", read)) == {"state_name", "county_name", "date_local", "pm25_raw", "aqi_raw"}


def test_state_filter_passes_the_window(table):
    rolling = series.rolling_average(cleanup.clean(table)).where(F.col("state_name") == "A")
    assert "EqualTo(state_name,A)" in plan(rolling)


def test_problem_predicates_reach_the_scan(table):
    assert "GreaterThan(aqi_raw,500)" in plan(audit.extreme_aqi_rows(table))
    assert "LessThan(pm25_raw,0.0)" in plan(audit.most_negative(table))


def test_cleanup_is_narrow_and_compiled(table):
    text = plan(cleanup.clean(table))
    assert "Exchange" not in text and "*(1) Project" in text


def test_top_k_and_group_limits(table):
    done = cleanup.clean(table)
    for df in (filters.explorer_rows(done, FilterState()), series.alarm_days(done),
               series.zscore_anomalies(done), summary.site_analysis(done)):
        assert "TakeOrderedAndProject" in plan(df)
    for df in (series.worst_days(done), series.good_air_streaks(done), series.forecast_history(done),
               audit.problem_examples(table)):
        assert "WindowGroupLimit" in plan(df)


def scans(text):
    return len(re.findall(r"FileScan parquet", text))


def test_one_scan_where_one_is_enough(table):
    done = cleanup.clean(table)
    for df in (audit.before_after(done), audit.cleanup_success(done), audit.quality_audit_pct(table),
               audit.problem_counts(table), audit.data_quality_metrics(done),
               summary.state_comparison(done), series.worst_days(done),
               summary.best_worst_states(summary.state_comparison(done)),
               summary.state_heatmap(summary.state_comparison(done))):
        assert scans(plan(df, run=True)) == 1
    assert scans(plan(audit.problem_examples(table), run=True)) <= 2
    # Figures, sketches of the quantiles' column, and what lies in their brackets.
    for df in (audit.quality_audit(table), audit.quality_audit_after(done), summary.kpi_metrics(done),
               summary.monthly_trends(done, FilterState.everything())):
        assert scans(plan(df, run=True)) <= 3


@pytest.mark.parametrize("name", sorted(set(catalog.all_queries()) - WRITING))
def test_no_python_workers_or_cartesian_products(spark, name):
    text = plan(catalog.all_queries()[name](spark, SF))
    for word in ("Python", "Pandas", "CartesianProduct"):
        assert word not in text
    # Nested-loop joins only ever take the one row of a global aggregate: figures, and the
    # brackets of each quantile, shown twice until a plan has run.
    assert text.count("BroadcastNestedLoopJoin") <= (12 if name == "audit_merged" else 3)


def test_large_table_is_never_the_broadcast_side(spark):
    text = plan(catalog.all_queries()["cleaned_rows"](spark, "/root/testdata/sf0.1"))
    assert text.count("BuildRight") == 3 and "BuildLeft" not in text


def jobs(spark):
    return set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_flags_do_not_shuffle_the_rows(spark, table, tmp_path):
    rows = cleanup.clean(table).select("state_name", "pm25_cleaned")
    for method in ("zscore", "iqr"):
        limits = anomalies.anomaly_limits(rows, "pm25_cleaned", method, ["state_name"])
        settled = anomalies.settle_limits(limits, str(tmp_path / method))
        before = jobs(spark)
        flagged = anomalies.flags(rows, settled, "pm25_cleaned", method, 3.0, ["state_name"])
        whole = anomalies.detect_anomalies(rows, "pm25_cleaned", method, keys=["state_name"])
        assert jobs(spark) == before  # lazy
        text = plan(flagged)
        assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
        assert whole.where("is_anomaly").count() == flagged.where("is_anomaly").count()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        anomalies.settle_limits(limits, str(tmp_path / "iqr"))


def test_many_limits_split_a_hot_group(spark, tmp_path):
    # A third of the rows are of one group, and too many groups to broadcast.
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k")
    rows = spark.range(0, 600_000, 1, 8).select(key, F.col("id").cast("double").alias("v"), F.lit("x" * 50).alias("p"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
                "spark.sql.shuffle.partitions": "8"}
    old = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        flagged = anomalies.detect_anomalies(rows, "v", "zscore", 3.0, ["k"], str(tmp_path / "limits"))
        assert "skew=true" in plan(flagged, run=True)
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_quantile_cells_are_broadcast_only_for_few_groups(spark, table):
    done = cleanup.clean(table)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        by_state = exact_quantiles(done, ["state_name"], "pm25_cleaned", {"m": 0.5})
        text = plan(by_state, run=True)
        assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
        assert "BroadcastHashJoin" in plan(summary.monthly_trends(done, FilterState.everything()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # At run time the true size of the cells decides.
    assert "BroadcastHashJoin" in plan(exact_quantiles(done, ["state_name"], "pm25_cleaned", {"m": 0.5}), run=True)


def test_counts_without_places_do_not_shuffle_by_place(table):
    done = cleanup.clean(table)
    for df in (audit.before_after(done), audit.cleanup_success(done), audit.quality_audit_pct(table),
               audit.quality_audit(table, approximate=True), audit.audit_both(done, approximate=True)):
        text = plan(df, run=True)
        assert "hashpartitioning" not in text and scans(text) == 1
