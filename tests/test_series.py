from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import by
from measurelake.model import FilterState
from measurelake.operators import anomalies, series, summary

START = date(2024, 1, 1)
EVERYTHING = FilterState.everything()


def days(state, *values, start=START, step=1):
    """One reading per day; None leaves the day out."""
    return [
        {"state_name": state, "date_local": start + timedelta(i * step), "pm25_cleaned": float(v)}
        for i, v in enumerate(values)
        if v is not None
    ]


def test_daily_mean_rounds_binary_and_null_policy(cleaned):
    df = cleaned(*days("A", 1.00), *days("A", 1.01), {"state_name": "B", "pm25_cleaned": None},
                 *days("B", 8.0))
    zero, skip = (by(series.daily_state(df, p), "state_name") for p in ("zero", "skip"))
    assert zero["A"]["pm25"] == 1.0 and zero["A"]["n"] == 2
    assert zero["B"]["pm25"] == 4.0 and skip["B"]["pm25"] == 8.0
    with pytest.raises(ValueError):
        series.daily_state(df, "other")


def test_alarm_thresholds(cleaned):
    df = cleaned(
        *days("exact100", 1.00, 2.00),
        *days("exact200", 1.00, 3.00),
        *days("above200", 1.00, 3.01),
        *days("zero", 0.0, 50.0),
        *days("gap", 5.0, None, 12.0),
        *days("first", 99.0),
    )
    alarms = by(series.alarm_days(df), "state_name")
    assert set(alarms) == {"exact200", "above200", "gap"}
    assert alarms["exact200"]["alarm_level"] == "WARNUNG"
    assert alarms["above200"]["alarm_level"] == "KRITISCH"
    assert alarms["gap"]["gestern"] == 5.0 and alarms["gap"]["prozent_change"] == 140.0
    assert [r.state_name for r in series.alarm_days(df, ["gap", "zero"]).collect()] == ["gap"]
    top = series.alarm_summary(series.alarm_days(df)).collect()[0]
    assert (top.kritisch, top.warnung, top.max_change, top.affected_states) == (1, 2, 201.0, 3)


def test_worst_days(cleaned):
    df = cleaned(*days("A", 10.0, 40.0, 40.0, 5.0, 30.0), *days("B", 7.0))
    rows = by(series.worst_days(df), "state_name", "rang")
    assert rows["A", 1]["date_local"] == START + timedelta(1)  # ties go to the earlier day
    assert rows["A", 2]["date_local"] == START + timedelta(2)
    assert rows["A", 1]["sprung"] == 30.0 and rows["A", 1]["sprung_typ"] == "Plötzlich"
    assert rows["A", 2]["sprung"] == 0.0 and rows["A", 2]["sprung_typ"] == "Normal"
    assert rows["A", 3]["vortag"] == 5.0
    assert rows["B", 1]["vortag"] is None and rows["B", 1]["sprung"] == 0.0
    assert rows["B", 1]["ueber_durchschnitt"] == -15.0  # mean of all days is 22
    total = series.worst_days_summary(series.worst_days(df)).collect()[0]
    assert (total.max_pm25, total.max_state, total.sudden_jumps) == (40.0, "A", 2)


def test_rolling_average_steps_over_rows(cleaned):
    df = cleaned(*days("A", 1.0, None, 3.0, 5.0), *days("B", *range(10)))
    rows = by(series.rolling_average(df), "state_name", "date_local")
    assert rows["A", START + timedelta(2)]["rolling_7day"] == 2.0
    assert rows["A", START + timedelta(2)]["trend_position"] == "Über Trend"
    assert rows["A", START]["trend_position"] == "Unter Trend"
    assert rows["B", START + timedelta(9)]["rolling_7day"] == 6.0
    total = by(series.rolling_summary(series.rolling_average(df)), "state_name")
    assert (total["A"]["days_above"], total["A"]["days_below"]) == (2, 1)


def test_streaks(cleaned):
    df = cleaned(
        *days("gap", 5.0, 5.0, None, 5.0, 5.0, 5.0),
        *days("ties", 5.0, 5.0, 20.0, 5.0, 5.0),
        *days("limit", 12.0, 11.999),
        *days("bad", 50.0),
    )
    rows = series.good_air_streaks(df, top_n=None).collect()
    got = sorted((r.state_name, r.tage, r.streak_start, r.streak_end) for r in rows)
    assert got == [
        ("gap", 3, START + timedelta(3), START + timedelta(5)),
        ("limit", 1, START + timedelta(1), START + timedelta(1)),
        ("ties", 2, START, START + timedelta(1)),
        ("ties", 2, START + timedelta(3), START + timedelta(4)),
    ]
    assert series.good_air_streaks(df, top_n=2).count() == 2


def test_zscores_leave_out_constant_states(cleaned):
    values = [10.0] * 20 + [100.0]
    df = cleaned(*days("A", *values), *days("constant", *[4.0] * 9), *days("single", 3.0))
    rows = series.zscore_anomalies(df).collect()
    assert {r.state_name for r in rows} == {"A"} and rows[0].pm25 == 100.0
    z = (100 - np.mean(values)) / np.std(values, ddof=1)
    assert rows[0].z_score == pytest.approx(z, abs=0.005)
    assert rows[0].anomaly_level == "Extreme Anomalie" and rows[-1].anomaly_level == "Normal"


def test_centered_mean_has_no_value_at_the_ends(spark):
    df = spark.createDataFrame([(f"2024-0{i}", float(i)) for i in range(1, 6)], "month string, avg_pm25 double")
    got = [r.ma3 for r in series.centered_mean(df).orderBy("month").collect()]
    assert got == [None, 2.0, 3.0, 4.0, None]


def test_history_keeps_the_newest_days(cleaned):
    df = cleaned(*days("A", *range(50)), *days("B", 1.0))
    rows = series.forecast_history(df, days_back=10).collect()
    assert sorted(r.pm25 for r in rows if r.state_name == "A") == [float(v) for v in range(40, 50)]
    assert len([r for r in rows if r.state_name == "B"]) == 1


def test_flags(spark):
    values = [10.0, 11.0, 9.0, 10.0, 12.0, 8.0, 10.0, 60.0, None]
    df = spark.createDataFrame([("A", v) for v in values] + [("C", 5.0), ("C", 5.0)], "k string, v double")
    known = np.array([v for v in values if v is not None])
    scores = np.abs((known - known.mean()) / known.std())
    got = anomalies.detect_anomalies(df, "v", "zscore", 2.0, ["k"]).where("k = 'A'").collect()
    flagged = {r.v: (r.anomaly_score, r.is_anomaly) for r in got}
    assert flagged[60.0][0] == pytest.approx(scores.max()) and flagged[60.0][1]
    assert flagged[None] == (None, False) and not flagged[10.0][1]
    alone = anomalies.detect_anomalies(df.where("k = 'C'"), "v").collect()
    assert all(r.anomaly_score is None and not r.is_anomaly for r in alone)
    outside = anomalies.detect_anomalies(df, "v", "iqr", 1.5, ["k"]).where("is_anomaly").collect()
    assert [r.v for r in outside] == [60.0]
    assert anomalies.detect_anomalies(df, "v", "iqr", 1.5).count() == df.count()
    with pytest.raises(ValueError):
        anomalies.detect_anomalies(df, "v", "magic")


def test_months_with_anomalies(cleaned):
    df = cleaned(*[{"date_local": date(2023 + i // 12, i % 12 + 1, 3), "pm25_cleaned": 50.0 if i == 7 else 10.0}
                   for i in range(20)])
    plain = FilterState.everything()
    flagged = summary.monthly_trends(df, replace(plain, show_anomalies=True), quartiles=False).collect()
    assert [r.month for r in flagged if r.is_anomaly] == ["2023-08"]
    assert "is_anomaly" not in summary.monthly_trends(df, plain).columns


def test_trend_direction(spark):
    rows = [("up", i, 10.0 + i) for i in range(5)] + [("down", i, 10.0 - i) for i in range(5)]
    rows += [("flat", i, 10.0) for i in range(5)] + [("one", 0, 3.0), ("nil", 0, -1.0), ("nil", 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = by(anomalies.trend_direction(df, "v", "i", ["k"]), "k")
    assert {k: r["direction"] for k, r in got.items()} == {
        "up": "increasing", "down": "decreasing", "flat": "stable", "one": "stable", "nil": "stable"}
    assert got["up"]["trend_pct"] == pytest.approx(100 / 12)
    assert got["one"]["trend_pct"] == 0.0 and got["nil"]["trend_pct"] == 0.0


# -- summaries ---------------------------------------------------------------


def test_monthly_trends_equal_numpy(cleaned):
    rng = np.random.default_rng(1)
    values = np.round(rng.gamma(2, 5, 400), 2)
    df = cleaned(*[{"state_name": "AB"[i % 2], "pm25_cleaned": float(v), "aqi_cleaned": float(i % 140),
                    "date_local": START + timedelta(i % 60)} for i, v in enumerate(values)])
    rows = by(summary.monthly_trends(df), "month")
    assert list(rows) == ["2024-01", "2024-02"]
    january = values[[i for i in range(400) if i % 60 < 31]]
    row = rows["2024-01"]
    assert row["measurements"] == len(january)
    for name, want in [("avg_pm25", january.mean()), ("std_pm25", january.std(ddof=1)),
                       ("q1_pm25", np.quantile(january, 0.25)), ("median_pm25", np.median(january)),
                       ("q3_pm25", np.quantile(january, 0.75))]:
        assert row[name] == pytest.approx(want, abs=0.0051), name
    both = summary.monthly_trends(df, FilterState(comparison_mode=True))
    assert both.count() == 4 and "state_name" in both.columns
    current = summary.current_aqi(both)
    assert {r.month for r in current.collect()} == {"2024-02"} and current.count() == 2


def test_monthly_trends_keep_null_states_and_months_without_values(cleaned):
    df = cleaned({"state_name": None, "pm25_cleaned": 3.0}, {"state_name": "A", "pm25_cleaned": None})
    rows = by(summary.monthly_trends(df, by_state=True), "state_name")
    assert rows[None]["median_pm25"] == 3.0 and rows["A"]["median_pm25"] is None


def test_state_comparison(cleaned):
    df = cleaned({"aqi_cleaned": 50.0}, {"aqi_cleaned": 51.0, "county_name": "d"},
                 {"aqi_cleaned": 101.0}, {"aqi_cleaned": None},
                 {"state_name": "B", "pm25_cleaned": 50.0})
    rows = summary.state_comparison(df).collect()
    assert [r.state_name for r in rows] == ["B", "A"]
    a = rows[1]
    assert (a.counties, a.measurements, a.good_days, a.moderate_days, a.unhealthy_days, a.pct_good_days) == (
        2, 4, 1, 1, 1, 25.0)
    sides = by(summary.best_worst_states(summary.state_comparison(df), 1), "side")
    assert sides["best"]["state_name"] == "A" and sides["worst"]["state_name"] == "B"
    heat = by(summary.state_heatmap(summary.state_comparison(df)), "state_name")
    assert heat["A"]["avg_pm25_scaled"] == 0.0 and heat["B"]["avg_pm25_scaled"] == 1.0


def test_heatmap_of_constant_measure_is_null(cleaned):
    df = cleaned({"state_name": "A"}, {"state_name": "B"})
    rows = summary.state_heatmap(summary.state_comparison(df)).collect()
    assert [r.avg_pm25_scaled for r in rows] == [None, None]


def quarter(state, q1, q4):
    rows = []
    for month, value in ((2, q1), (11, q4)):
        if value is not None:
            rows.append({"state_name": state, "date_local": date(2024, month, 1), "pm25_cleaned": value})
    return rows


def test_quarterly_trend(cleaned):
    df = cleaned(*quarter("better", 10.0, 8.0), *quarter("worse", 5.0, 7.5), *quarter("edge", 5.0, 4.0),
                 *quarter("same", 0.0, 0.5), *quarter("q1 only", 9.0, None))
    rows = by(summary.quarterly_trend(df), "state_name")
    assert {s: r["kategorie"] for s, r in rows.items()} == {
        "better": "Verbessert", "worse": "Verschlechtert", "edge": "Stabil", "same": "Stabil"}
    assert rows["better"]["improvement_rank"] == 1 and rows["better"]["prozent_change"] == -20.0
    assert rows["same"]["prozent_change"] is None
    assert by(summary.quarterly_summary(summary.quarterly_trend(df)), "kategorie")["Stabil"]["states"] == 2
    changes = by(summary.top_changes(summary.quarterly_trend(df)), "kategorie")
    assert changes["Verbessert"]["state_name"] == "better"
    assert changes["Verschlechtert"]["state_name"] == "worse"


def test_distribution_options(cleaned):
    df = cleaned({"aqi_cleaned": None, "aqi_original": None}, {"aqi_cleaned": 10.0, "aqi_original": 400})
    assert [r["count"] for r in summary.aqi_distribution(df).collect()] == [1, 1]
    original = summary.aqi_distribution(df, source="original", percent=True).collect()
    assert [(r.category[0], r["count"], r.percent) for r in original] == [("6", 1, 100.0)]
    named = summary.aqi_distribution(df, null_label="unknown").collect()
    assert {r.category for r in named} == {"1. Good (0-50)", "unknown"}
    with pytest.raises(ValueError):
        summary.aqi_distribution(df, source="x")


def test_weekdays_seasons_sites(cleaned):
    df = cleaned({"date_local": date(2024, 1, 6), "site_name": None}, {"date_local": date(2024, 1, 7)},
                 {"date_local": date(2024, 7, 1), "aqi_cleaned": 150.0, "pm25_cleaned": 60.0})
    assert [r.wochentag for r in summary.weekday_analysis(df).collect()] == ["Sonntag", "Montag", "Samstag"]
    kinds = by(summary.weekend_vs_weekday(df), "day_type")
    assert kinds["Weekend"]["measurements"] == 2
    assert by(summary.seasonal_pattern(df), "season")["Summer"]["unhealthy_days"] == 1
    assert {r.site_name for r in summary.site_analysis(df).collect()} == {None, "s"}
    assert [r.site_name for r in summary.site_hotspots(df).collect()] == ["s"]
    assert summary.worst_national_day(df).collect()[0].date_local == date(2024, 7, 1)
    dive = summary.event_deep_dive(df, "A", date(2024, 7, 1), date(2024, 7, 31), aqi_above=100).collect()
    assert [(r.aqi_cleaned, r.aqi_category[0]) for r in dive] == [(150.0, "3")]
    assert summary.worst_states(df).collect()[0].unhealthy_days == 1


def test_kpis(cleaned):
    df = cleaned({"pm25_original": -1.0, "pm25_cleaned": 0.0, "cleanup_action": "NEGATIVE_FIXED"},
                 {"aqi_original": 900, "aqi_cleaned": 500.0, "cleanup_action": "AQI_CAPPED"},
                 {"aqi_original": None, "cleanup_action": "AQI_CALCULATED"}, {})
    row = summary.kpi_metrics(df).collect()[0]
    assert (row.total_rows, row.unique_states, row.negative_fixed, row.null_aqi_fixed,
            row.extreme_aqi_capped, row.cleaned_records) == (4, 1, 1, 1, 1, 3)
    assert row.median_pm25 == 10.0 and row.avg_pm25 == 7.5


def test_hot_state_holds_a_third_of_all_rows(spark, cleaned):
    base = cleaned({}).limit(1)
    many = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("state_name"),
        F.date_add(F.lit(START), (F.col("id") % 200).cast("int")).alias("date_local"),
        (F.col("id") % 97).cast("double").alias("pm25_cleaned"),
    )
    df = many.crossJoin(base.drop("state_name", "date_local", "pm25_cleaned"))
    rows = by(summary.state_comparison(df, EVERYTHING), "state_name")
    assert rows["hot"]["measurements"] == 10000
    daily = series.daily_state(df).where("state_name = 'hot'")
    assert daily.count() == 200 and daily.agg(F.sum("n")).collect()[0][0] == 10000
