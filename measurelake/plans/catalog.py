"""Every query by name: a callable from (session, data folder) to a DataFrame.

All of them run over the whole test tables, seen as measurements (see
:mod:`measurelake.sources.fixture`).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measurelake.functions import scalar
from measurelake.functions.quantiles import exact_quantiles
from measurelake.model import CleanupConfig, ColumnMap, FilterState
from measurelake.operators import anomalies, audit, cleanup, filters, forecast, rollup, series, summary
from measurelake.plans.incremental import run_months
from measurelake.plans.pipeline import run_cleanup
from measurelake.sources import readers, skipping, writers
from measurelake.sources.fixture import event_readings, measurements

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}

# The selections the queries run with; the test tables span 1995 to 2001.
SELECTION = FilterState(("ASIA", "EUROPE"), date(1996, 1, 1), date(1998, 12, 31))
WHOLE = FilterState.everything()
PLAIN = ColumnMap(**{name: name for name in ColumnMap().pairs()})
NARROW_BAND = 0.05  # quarters of the test tables differ by less than 1 µg/m³


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _cleaned(spark: SparkSession, sf: str, config: CleanupConfig = CleanupConfig()) -> DataFrame:
    return cleanup.clean(measurements(spark, sf), config)


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return series.forecast_history(_cleaned(spark, sf))


def _event_history(spark: SparkSession, sf: str) -> DataFrame:
    return series.forecast_history(event_readings(spark, sf))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded, so that results compare across engines."""
    return df.select(
        *[
            scalar.round_half_up(F.col(c), digits).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


# -- sources and sinks -------------------------------------------------------


@_query
def src_csv_roundtrip(spark, sf):
    columns = ColumnMap()
    path = writers.working_path(spark, "raw-csv")
    writers.write_csv(columns.to_source(measurements(spark, sf)), path)
    return readers.read_csv(spark, path, columns)


def _quoted_names(df: DataFrame) -> DataFrame:
    """Site names as published files have them: with quotes, commas, blanks and backslashes."""
    site = F.col("site_name")
    return df.withColumn(
        "site_name",
        F.when(F.col("aqi_raw") % 4 == 0, F.concat(F.lit('Near "Road" '), site, F.lit(", N")))
        .when(F.col("aqi_raw") % 4 == 1, F.concat(F.lit("  "), site, F.lit(" \\ ")))
        .when(F.col("aqi_raw") % 4 == 2, F.lit("")).otherwise(site),
    )


@_query
def src_csv_quoted(spark, sf):
    columns = ColumnMap()
    path = writers.working_path(spark, "quoted-csv")
    writers.write_csv(columns.to_source(_quoted_names(measurements(spark, sf))), path)
    return readers.read_csv(spark, path, columns)


@_query
def sink_parquet_roundtrip(spark, sf):
    target = writers.working_path(spark, "export")
    paths = writers.export_cleaned(_cleaned(spark, sf), target, by_month=True)
    return readers.read_parquet(spark, paths["parquet"])


@_query
def src_month_folders(spark, sf):
    """A selection of dates read back from an export in month folders."""
    target = writers.working_path(spark, "export")
    paths = writers.export_cleaned(_cleaned(spark, sf), target, by_month=True)
    exported = readers.read_parquet(spark, paths["parquet"], keep_folders=True)
    return filters.apply_filter(exported, SELECTION).drop("year", "month")


@_query
def sink_csv_roundtrip(spark, sf):
    target = writers.working_path(spark, "export")
    config = CleanupConfig(export_format="csv")
    paths = writers.export_cleaned(_cleaned(spark, sf), target, config)
    return readers.read_csv(spark, paths["csv"])


@_query
def sink_explorer_csv(spark, sf):
    rows = filters.explorer_rows(_cleaned(spark, sf), SELECTION, limit=1000)
    return readers.read_csv(spark, writers.write_csv(rows, writers.working_path(spark, "rows")), PLAIN)


@_query
def schema_profile(spark, sf):
    names = ["state_name", "county_name", "date_local", "pm25_raw", "aqi_raw", "observation_percent"]
    return readers.schema_profile(measurements(spark, sf), names)


@_query
def export_projection(spark, sf):
    return writers.export_projection(_cleaned(spark, sf), include_cleanup_flags=False)


@_query
def cleanup_report(spark, sf):
    return audit.cleanup_report(_cleaned(spark, sf))


def _stored_measurements(spark: SparkSession, sf: str) -> str:
    """The measurements as a published Parquet table, under the published column names."""
    raw = ColumnMap().to_source(measurements(spark, sf))
    return writers.write_parquet(raw, writers.working_path(spark, "published"))


@_query
def src_first_available(spark, sf):
    """The first of several paths that exists is opened."""
    target = writers.working_path(spark, "export")
    paths = writers.export_cleaned(_cleaned(spark, sf), target)
    return readers.read_first_available(spark, [f"{target}_missing.parquet", paths["parquet"]])


@_query
def run_cleaned_view(spark, sf):
    """What a cleanup run leaves behind as a view, queried in SQL."""
    config = CleanupConfig(show_examples=False, verbose=False)
    run_cleanup(spark, _stored_measurements(spark, sf), writers.working_path(spark, "run"), config)
    return spark.sql(
        "SELECT state_name, cleanup_action, COUNT(*) AS rows FROM cleaned_data "
        "GROUP BY state_name, cleanup_action")


@_query
def run_report_lines(spark, sf):
    """The report that a cleanup run writes, line by line."""
    config = CleanupConfig(show_examples=False)
    run = run_cleanup(
        spark, _stored_measurements(spark, sf), writers.working_path(spark, "run"), config)
    return spark.read.text(run.paths["report"]).withColumnRenamed("value", "line")


@_query
def sink_both_formats(spark, sf):
    """Rows of one export in both formats, by format, state and action."""
    paths = writers.export_cleaned(
        _cleaned(spark, sf), writers.working_path(spark, "export"), CleanupConfig(export_format="both"))
    read = {"parquet": readers.read_parquet, "csv": readers.read_csv}
    both = [read[name](spark, path).withColumn("format", F.lit(name)) for name, path in paths.items()]
    return reduce(DataFrame.unionByName, both).groupBy("format", "state_name", "cleanup_action").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("aqi_cleaned").alias("sum_aqi"),
        F.count("site_name").alias("named_sites"),
    )


@_query
def sink_output_size(spark, sf):
    """Whether each format of an export has files, and bytes in them."""
    paths = writers.export_cleaned(
        _cleaned(spark, sf), writers.working_path(spark, "export"), CleanupConfig(export_format="both"))
    sizes = [writers.output_size(spark, path).select(
        F.lit(name).alias("format"), (F.col("files") > 0).alias("has_files"),
        (F.col("size_mb") > 0).alias("has_bytes")) for name, path in paths.items()]
    return reduce(DataFrame.union, sizes)


@_query
def src_csv_layouts(spark, sf):
    """Files of two layouts in one folder: the later years lack a column and have another order."""
    columns = ColumnMap()
    folder = writers.working_path(spark, "yearly")
    rows = columns.to_source(measurements(spark, sf))
    later = F.year(F.col(f"`{columns.date_local}`")) >= 1998
    writers.write_csv(rows.where(~later), f"{folder}/early")
    other = [c for c in reversed(rows.columns) if c != columns.site_name]
    writers.write_csv(rows.where(later).select(*[F.col(f"`{c}`") for c in other]), f"{folder}/late")
    return readers.read_csv_folder(spark, folder, columns)


@_query
def src_csv_quarantine(spark, sf):
    """Readings of a file with bad cells by state, and its rejected lines by reason."""
    columns = ColumnMap()
    path = writers.working_path(spark, "damaged")
    rows = measurements(spark, sf)
    bad_index, bad_day = F.col("aqi_raw") % 25 == 7, F.col("pm25_raw") < -2
    damaged = rows.withColumns({
        "aqi_raw": F.when(bad_index, "n/a").otherwise(F.col("aqi_raw").cast("string")),
        "date_local": F.when(bad_day, "unknown").otherwise(F.col("date_local").cast("string"))})
    writers.write_csv(columns.to_source(damaged), path)
    table, rejects = readers.read_csv_checked(spark, path, columns)
    count = F.count(F.lit(1)).alias("rows")
    kept = table.groupBy(F.lit("kept").alias("kind"), F.col("state_name").alias("name")).agg(
        count, F.sum("pm25_raw").alias("sum_pm25"))
    gone = rejects.groupBy(F.lit("rejected").alias("kind"), F.col("reason").alias("name")).agg(
        count, F.lit(None).cast("double").alias("sum_pm25"))
    return kept.union(gone)


@_query
def sink_clustered(spark, sf):
    """A selection of states and dates read back from a table ordered by both."""
    path = skipping.write_clustered(_cleaned(spark, sf), writers.working_path(spark, "clustered"))
    return filters.apply_filter(readers.read_parquet(spark, path), SELECTION)


@_query
def search_indexed(spark, sf):
    """A text searched in the files that hold it."""
    path = skipping.write_clustered(
        _cleaned(spark, sf), writers.working_path(spark, "clustered"), PLAIN, ("county_name",))
    index = skipping.write_token_index(spark, path, writers.working_path(spark, "tokens"))
    return skipping.search_indexed(spark, path, index, "nation_7")


def _corrected_months(spark, sf):
    """A table written from a faulty source, of which two months are then run again from the right one."""
    right = _stored_measurements(spark, sf)
    columns = ColumnMap()
    day, level = F.col(f"`{columns.date_local}`"), F.col(f"`{columns.pm25_raw}`")
    month = F.trunc(day, "month")
    faulty = spark.read.parquet(right).where(month != F.lit(date(1997, 3, 1))).withColumn(
        columns.pm25_raw, F.when(month == F.lit(date(1996, 7, 1)), level + 1).otherwise(level))
    target = writers.working_path(spark, "months")
    path = writers.write_parquet(faulty, writers.working_path(spark, "faulty"))
    run_months(spark, path, target)
    return run_months(spark, right, target, [date(1997, 3, 15), date(1996, 7, 1)])


@_query
def months_corrected(spark, sf):
    return _corrected_months(spark, sf).cleaned


@_query
def months_report(spark, sf):
    """The report of all months after a run of two, from stored parts."""
    return _corrected_months(spark, sf).report


@_query
def months_rollup(spark, sf):
    """States compared by the rollup that month runs keep up to date."""
    return rollup.state_comparison(_corrected_months(spark, sf).rollup, WHOLE)


# -- filters and rows --------------------------------------------------------


@_query
def filter_measurements(spark, sf):
    return filters.apply_filter(_cleaned(spark, sf), SELECTION, [F.col("pm25_cleaned") > 20])


@_query
def explorer_rows(spark, sf):
    return filters.explorer_rows(_cleaned(spark, sf), SELECTION, limit=1000)


@_query
def explorer_search(spark, sf):
    return filters.explorer_rows(_cleaned(spark, sf), SELECTION, limit=500, term="nation_7|supplier#0+13$")


@_query
def states_list(spark, sf):
    return filters.states_list(_cleaned(spark, sf))


# -- cleanup -----------------------------------------------------------------


@_query
def cleaned_rows(spark, sf):
    return _cleaned(spark, sf)


@_query
def cleaned_zero_strategy(spark, sf):
    return _cleaned(spark, sf, CleanupConfig(null_aqi_strategy="zero"))


@_query
def cleaned_without_fixes(spark, sf):
    config = CleanupConfig(fix_negative_pm25=False, cap_extreme_aqi=False)
    return _cleaned(spark, sf, config)


@_query
def aqi_from_pm25(spark, sf):
    rows = measurements(spark, sf).groupBy("pm25_raw").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(rows.withColumn("aqi", scalar.aqi_from_pm25(F.col("pm25_raw"))))


@_query
def cleanup_summary(spark, sf):
    return cleanup.cleanup_summary(_cleaned(spark, sf))


@_query
def cleanup_summary_negative_first(spark, sf):
    rows = cleanup.clean(measurements(spark, sf), negative_first=True)
    return cleanup.cleanup_summary(filters.apply_filter(rows, SELECTION))


@_query
def quality_distribution(spark, sf):
    return cleanup.quality_distribution(_cleaned(spark, sf))


# -- audit -------------------------------------------------------------------


@_query
def quality_audit(spark, sf):
    return audit.quality_audit(measurements(spark, sf))


@_query
def quality_audit_pct(spark, sf):
    return audit.quality_audit_pct(measurements(spark, sf))


@_query
def quality_audit_after(spark, sf):
    return audit.quality_audit_after(_cleaned(spark, sf))


@_query
def before_after(spark, sf):
    return audit.before_after(_cleaned(spark, sf))


@_query
def cleanup_success(spark, sf):
    return audit.cleanup_success(_cleaned(spark, sf))


@_query
def problem_counts(spark, sf):
    return audit.problem_counts(measurements(spark, sf))


@_query
def problem_examples(spark, sf):
    return audit.problem_examples(measurements(spark, sf), portable=True)


@_query
def problem_example_counts(spark, sf):
    # The default draw picks other rows, but as many of each class; only rows that are
    # of the class they were drawn for are counted.
    config = CleanupConfig(example_limit=25)
    rows = audit.problem_examples(measurements(spark, sf), config)
    right = [(F.col("problem") == name) & test
             for name, (test, _) in audit.problem_classes(config).items()]
    return rows.where(reduce(or_, right)).groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


@_query
def audit_merged(spark, sf):
    """Both audits from parts of months, merged to years and then to one.

    Medians are approximate: whether each lies between the quantiles at 0.49 and 0.51.
    """
    cleaned = _cleaned(spark, sf)
    months = audit.audit_states(cleaned.withColumn("month", F.trunc("date_local", "month")), keys=["month"])
    months = writers.settle(months, "states")
    years = audit.merge_audit_states(months.withColumn("year", F.year("month")), ["year"])
    row = audit.audit_of_states(years)
    for side, suffix in (("before", "original"), ("after", "cleaned")):
        for metric in ("pm25", "aqi"):
            near = exact_quantiles(cleaned, [], f"{metric}_{suffix}", {"low": 0.49, "high": 0.51})
            name = f"{side}_median_{metric}"
            row = row.crossJoin(F.broadcast(near)).withColumn(
                name, F.col(name).between(F.col("low") - 0.005, F.col("high") + 0.005)).drop("low", "high")
    return row


@_query
def data_quality_metrics(spark, sf):
    return audit.data_quality_metrics(_cleaned(spark, sf))


@_query
def state_quality(spark, sf):
    return audit.state_quality(measurements(spark, sf))


@_query
def extreme_aqi_rows(spark, sf):
    return audit.extreme_aqi_rows(measurements(spark, sf))


@_query
def most_negative(spark, sf):
    return audit.most_negative(measurements(spark, sf))


@_query
def negative_corrections(spark, sf):
    return audit.negative_corrections(measurements(spark, sf), limit=None)


@_query
def aqi_capping(spark, sf):
    return audit.aqi_capping(measurements(spark, sf))


@_query
def aqi_fill_status(spark, sf):
    return audit.aqi_fill_status(measurements(spark, sf))


@_query
def low_observation(spark, sf):
    return audit.low_observation(measurements(spark, sf))


# -- summaries ---------------------------------------------------------------


@_query
def kpi_metrics(spark, sf):
    return summary.kpi_metrics(_cleaned(spark, sf))


@_query
def monthly_trends(spark, sf):
    return summary.monthly_trends(_cleaned(spark, sf), WHOLE)


@_query
def monthly_trends_by_state(spark, sf):
    return summary.monthly_trends(_cleaned(spark, sf), SELECTION, by_state=True)


@_query
def state_comparison(spark, sf):
    return summary.state_comparison(_cleaned(spark, sf), WHOLE)


@_query
def best_worst_states(spark, sf):
    return summary.best_worst_states(summary.state_comparison(_cleaned(spark, sf), WHOLE), n=3)


@_query
def state_heatmap(spark, sf):
    return summary.state_heatmap(summary.state_comparison(_cleaned(spark, sf), WHOLE))


@_query
def aqi_distribution(spark, sf):
    return summary.aqi_distribution(_cleaned(spark, sf), SELECTION)


@_query
def aqi_distribution_pct(spark, sf):
    return summary.aqi_distribution(_cleaned(spark, sf), WHOLE, source="original", percent=True)


@_query
def pm25_levels(spark, sf):
    return summary.pm25_levels(_cleaned(spark, sf), WHOLE)


@_query
def current_aqi(spark, sf):
    monthly = summary.monthly_trends(_cleaned(spark, sf), WHOLE, by_state=True, quartiles=False)
    return summary.current_aqi(monthly)


@_query
def trend_summary(spark, sf):
    return summary.trend_summary(summary.monthly_trends(_cleaned(spark, sf), WHOLE))


@_query
def quarterly_trend(spark, sf):
    return summary.quarterly_trend(_cleaned(spark, sf))


@_query
def quarterly_summary(spark, sf):
    return summary.quarterly_summary(summary.quarterly_trend(_cleaned(spark, sf), NARROW_BAND))


@_query
def top_changes(spark, sf):
    return summary.top_changes(summary.quarterly_trend(_cleaned(spark, sf), NARROW_BAND))


@_query
def weekday_analysis(spark, sf):
    return summary.weekday_analysis(_cleaned(spark, sf))


@_query
def weekend_vs_weekday(spark, sf):
    return summary.weekend_vs_weekday(_cleaned(spark, sf))


@_query
def seasonal_pattern(spark, sf):
    return summary.seasonal_pattern(_cleaned(spark, sf))


@_query
def site_analysis(spark, sf):
    return summary.site_analysis(_cleaned(spark, sf), WHOLE)


@_query
def site_hotspots(spark, sf):
    return summary.site_hotspots(_cleaned(spark, sf))


@_query
def worst_states(spark, sf):
    return summary.worst_states(_cleaned(spark, sf))


@_query
def event_deep_dive(spark, sf):
    return summary.event_deep_dive(
        _cleaned(spark, sf), "AMERICA", date(1996, 1, 1), date(1998, 12, 31), aqi_above=90
    )


@_query
def worst_national_day(spark, sf):
    return summary.worst_national_day(_cleaned(spark, sf))


# -- the same from a stored daily rollup -------------------------------------


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    path = rollup.write_rollup(rollup.daily_rollup(_cleaned(spark, sf)), writers.working_path(spark, "rollup"))
    return rollup.read_rollup(spark, path)


@_query
def rollup_state_comparison(spark, sf):
    return rollup.state_comparison(_rollup(spark, sf), WHOLE)


@_query
def rollup_quarterly_trend(spark, sf):
    return rollup.quarterly_trend(_rollup(spark, sf))


@_query
def rollup_weekday_analysis(spark, sf):
    return rollup.weekday_analysis(_rollup(spark, sf))


@_query
def rollup_site_analysis(spark, sf):
    return rollup.site_analysis(_rollup(spark, sf), WHOLE)


@_query
def rollup_monthly_means(spark, sf):
    return rollup.monthly_means(_rollup(spark, sf), WHOLE)


@_query
def rollup_forecast_history(spark, sf):
    return rollup.forecast_history(_rollup(spark, sf))


# -- daily series ------------------------------------------------------------


@_query
def daily_state(spark, sf):
    return series.daily_state(_cleaned(spark, sf)).drop("pm25_exact")


@_query
def daily_state_skip_nulls(spark, sf):
    return series.daily_state(event_readings(spark, sf), null_policy="skip").drop("pm25_exact")


@_query
def alarm_days(spark, sf):
    return series.alarm_days(_cleaned(spark, sf))


@_query
def alarm_days_all(spark, sf):
    return series.alarm_days(_cleaned(spark, sf), limit=None)


@_query
def alarm_days_critical(spark, sf):
    alarms = series.alarm_days(_cleaned(spark, sf), limit=None)
    return filters.with_label(alarms, "alarm_level", ["KRITISCH"])


@_query
def alarm_summary(spark, sf):
    return series.alarm_summary(series.alarm_days(_cleaned(spark, sf), limit=None))


@_query
def worst_days(spark, sf):
    return series.worst_days(_cleaned(spark, sf))


@_query
def worst_days_summary(spark, sf):
    return series.worst_days_summary(series.worst_days(_cleaned(spark, sf)))


@_query
def rolling_average(spark, sf):
    return series.rolling_average(_cleaned(spark, sf))


@_query
def rolling_summary(spark, sf):
    return series.rolling_summary(series.rolling_average(_cleaned(spark, sf)))


@_query
def good_air_streaks(spark, sf):
    return series.good_air_streaks(_cleaned(spark, sf))


@_query
def zscore_anomalies(spark, sf):
    return series.zscore_anomalies(_cleaned(spark, sf))


@_query
def zscore_anomalies_strong(spark, sf):
    scores = series.zscore_anomalies(_cleaned(spark, sf), limit=None)
    return filters.with_label(scores, "anomaly_level", ["Extreme Anomalie", "Starke Anomalie"])


@_query
def zscore_anomalies_events(spark, sf):
    return series.zscore_anomalies(event_readings(spark, sf), limit=None)


@_query
def trend_centered_ma(spark, sf):
    return series.centered_mean(summary.monthly_trends(_cleaned(spark, sf), WHOLE))


@_query
def forecast_history(spark, sf):
    return _history(spark, sf)


# -- anomalies and trend -----------------------------------------------------


@_query
def anomalies_zscore(spark, sf):
    monthly = summary.monthly_trends(_cleaned(spark, sf), WHOLE, quartiles=False)
    monthly = monthly.select("month", "avg_pm25")
    return _rounded(anomalies.detect_anomalies(monthly, "avg_pm25", "zscore", 2.5))


@_query
def anomalies_zscore_rows(spark, sf):
    rows = _cleaned(spark, sf).select("state_name", "date_local", "pm25_cleaned")
    flagged = anomalies.detect_anomalies(
        rows, "pm25_cleaned", "zscore", 3.0, ["state_name"],
        settled=writers.working_path(spark, "limits"),
    )
    return _rounded(flagged.where("is_anomaly"))


@_query
def anomalies_iqr(spark, sf):
    rows = _cleaned(spark, sf).select("state_name", "date_local", "pm25_cleaned")
    flagged = anomalies.detect_anomalies(
        rows, "pm25_cleaned", "iqr", 1.5, ["state_name"],
        settled=writers.working_path(spark, "limits"),
    )
    return flagged.where("is_anomaly")


@_query
def trend_direction(spark, sf):
    daily = series.daily_state(_cleaned(spark, sf))
    return _rounded(anomalies.trend_direction(daily, "pm25", "date_local", ["state_name"]))


# -- forecasts ---------------------------------------------------------------


@_query
def linreg_fit(spark, sf):
    return _rounded(forecast.linreg_fit(_history(spark, sf)))


@_query
def linreg_metrics(spark, sf):
    return _rounded(forecast.linreg_metrics(_history(spark, sf)))


@_query
def linreg_fitted(spark, sf):
    return _rounded(forecast.linreg_fitted(_history(spark, sf)))


@_query
def linreg_forecast(spark, sf):
    return _rounded(forecast.linreg_forecast(_history(spark, sf)))


@_query
def linreg_forecast_events(spark, sf):
    return _rounded(forecast.linreg_forecast(_event_history(spark, sf)))


@_query
def ma_fit(spark, sf):
    return _rounded(forecast.ma_fit(_history(spark, sf)))


@_query
def ma_forecast(spark, sf):
    return _rounded(forecast.ma_forecast(_history(spark, sf)))


@_query
def ma_forecast_noisy(spark, sf):
    return _rounded(forecast.ma_forecast(_history(spark, sf), seed=7))


@_query
def seasonal_forecast(spark, sf):
    return _rounded(forecast.seasonal_forecast(_history(spark, sf)))


@_query
def seasonal_forecast_events(spark, sf):
    return _rounded(forecast.seasonal_forecast(_event_history(spark, sf)))


@_query
def piecewise_forecast(spark, sf):
    return _rounded(forecast.piecewise_forecast(_history(spark, sf)))


@_query
def seasonal_summary(spark, sf):
    return _rounded(forecast.seasonal_summary(_history(spark, sf)))


@_query
def forecast_comparison(spark, sf):
    return _rounded(forecast.forecast_comparison(_history(spark, sf)))


@_query
def forecast_model_stats(spark, sf):
    return _rounded(forecast.forecast_model_stats(forecast.forecast_comparison(_history(spark, sf))))
