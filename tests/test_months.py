"""Month runs, mergeable audits and the daily rollup."""

from __future__ import annotations

from datetime import date
from pathlib import Path

import pytest
from conftest import by
from pyspark.sql import functions as F

from measurelake.model import ColumnMap, FilterState
from measurelake.operators import audit, cleanup, rollup, series, summary
from measurelake.plans.incremental import in_months, run_months
from measurelake.plans.pipeline import run_cleanup
from measurelake.sources import writers


@pytest.fixture()
def year(raw):
    """Readings of five months with nulls in every column, ties and repeated rows."""
    rows = []
    for i in range(300):
        rows.append(dict(
            state_name=[None, "A", "A", "B"][i % 4], county_name=["c", None, "d"][i % 3],
            site_name=None if i % 7 == 0 else f"s{i % 5}", date_local=date(2024, 1 + i % 5, 1 + i % 28),
            pm25_raw=None if i % 11 == 0 else (i % 90) * 2.25 - 6, aqi_raw=None if i % 5 == 0 else i * 3 % 620,
            observation_percent=None if i % 13 == 0 else float(i % 101)))
    return raw(*rows, *rows[:9])


@pytest.fixture()
def source(year, tmp_path):
    return writers.write_parquet(ColumnMap().to_source(year), str(tmp_path / "source"))


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("part-*")}


def plain(df):
    return sorted(map(str, df.collect()))


def test_a_rerun_rewrites_its_months_only(spark, year, source, tmp_path):
    target = str(tmp_path / "out")
    first = run_months(spark, source, target)
    before = {n: files(p) for n, p in first.paths.items()}
    rows, parts = plain(first.cleaned), plain(first.parts)
    again = run_months(spark, source, target, [date(2024, 2, 9)])
    assert plain(again.cleaned) == rows == plain(cleanup.clean(year))
    for name, path in again.paths.items():
        after = files(path)
        kept = {f: t for f, t in before[name].items() if "month=2/" not in f}
        assert kept == {f: t for f, t in after.items() if "month=2/" not in f}
        assert not set(before[name]) - set(kept) & set(after)
    third = run_months(spark, source, target, [date(2024, 2, 1)])
    assert plain(third.cleaned) == rows and plain(third.parts) == parts


def test_report_and_figures_equal_a_full_run(spark, source, tmp_path):
    run = run_months(spark, source, str(tmp_path / "months"))
    for month in (1, 4):
        run = run_months(spark, source, str(tmp_path / "months"), [date(2024, month, 1)])
    full = run_cleanup(spark, source, str(tmp_path / "full"))
    assert plain(run.summary) == plain(full.summary) and plain(run.quality) == plain(full.quality)
    assert plain(run.success) == plain(full.success)
    assert plain(run.report) == plain(audit.cleanup_report_of(full.audit))


def test_a_month_that_lost_its_rows_goes(spark, source, tmp_path):
    target = str(tmp_path / "out")
    run_months(spark, source, target)
    left = spark.read.parquet(source).where(F.month("`Date Local`") != 3)
    path = writers.write_parquet(left, str(tmp_path / "left"))
    run = run_months(spark, path, target, [date(2024, 3, 1), date(2024, 4, 1), date(2030, 1, 1)])
    assert run.cleaned.where(F.month("date_local") == 3).count() == 0
    assert run.parts.where(F.month("month_start") == 3).count() == 0
    assert run.rollup.where(F.month("date_local") == 3).count() == 0
    assert run.cleaned.count() == left.count()


def test_readings_without_a_date_belong_to_full_runs(spark, raw, tmp_path):
    rows = raw({"date_local": None}, {"date_local": date(2024, 2, 1)}, {"date_local": date(2024, 12, 31)})
    path = writers.write_parquet(ColumnMap().to_source(rows), str(tmp_path / "source"))
    target = str(tmp_path / "out")
    assert run_months(spark, path, target).cleaned.count() == 3
    assert run_months(spark, path, target, [date(2024, 12, 1)]).cleaned.count() == 3
    assert rows.where(in_months("date_local", [date(2024, 12, 5)])).count() == 1


def test_an_empty_table(spark, year, tmp_path):
    path = writers.write_parquet(ColumnMap().to_source(year.where("false")), str(tmp_path / "source"))
    for months in (None, [date(2024, 1, 1)]):
        run = run_months(spark, path, str(tmp_path / "out"), months)
        assert run.cleaned.count() == run.rollup.count() == 0
        assert run.audit.first().total_rows == 0 and run.audit.first().before_median_pm25 is None


def test_merged_states_equal_the_audit(spark, year):
    done = cleanup.clean(year)
    states = writers.settle(
        audit.audit_states(done.withColumn("m", F.month("date_local")), keys=["m"]), "states")
    whole = audit.audit_both(done, medians=True).first().asDict()
    once = audit.audit_of_states(states).first().asDict()
    twice = audit.audit_of_states(audit.merge_audit_states(states.withColumn("h", F.col("m") > 2), ["h"])).first().asDict()
    medians = [n for n in whole if "median" in n]
    assert {k: v for k, v in once.items() if k not in medians} == {k: v for k, v in whole.items() if k not in medians}
    assert {k: v for k, v in twice.items() if k not in medians} == {k: v for k, v in whole.items() if k not in medians}
    exact = audit.medians_of_states(states, done).first().asDict()
    for name in medians:
        assert exact[name] == whole[name]
        assert abs(once[name] - whole[name]) <= 3
    nothing = audit.audit_of_states(audit.audit_states(done.where("false"))).first()
    assert nothing.total_rows == 0 and nothing.before_median_pm25 is None


def test_rollup_answers_as_the_readings_do(spark, year, tmp_path):
    done = cleanup.clean(year)
    path = rollup.write_rollup(rollup.daily_rollup(done), str(tmp_path / "rollup"))
    stored = rollup.read_rollup(spark, path)
    everything = FilterState.everything()
    part = FilterState(("A",), date(2024, 2, 1), date(2024, 4, 10))
    for selection in (everything, part):
        assert plain(rollup.state_comparison(stored, selection)) == plain(summary.state_comparison(done, selection))
        assert plain(rollup.site_analysis(stored, selection, None)) == plain(summary.site_analysis(done, selection, None))
        direct = summary.monthly_trends(done, selection, quartiles=False)
        assert plain(rollup.monthly_means(stored, selection)) == plain(direct)
    direct = summary.monthly_trends(done, everything, by_state=True, quartiles=False)
    ours = by(rollup.monthly_means(stored, everything, by_state=True), "month", "state_name")
    assert ours == by(direct, "month", "state_name")
    assert plain(rollup.quarterly_trend(stored)) == plain(summary.quarterly_trend(done))
    assert plain(rollup.weekday_analysis(stored)) == plain(summary.weekday_analysis(done))
    assert plain(rollup.forecast_history(stored)) == plain(series.forecast_history(done))
    fewer = rollup.merged(rollup.merged(stored, ["state_name", "date_local"]), ["state_name"])
    assert plain(fewer.select("state_name", "n", F.round("m2_pm25", 6))) == plain(
        rollup.merged(stored, ["state_name"]).select("state_name", "n", F.round("m2_pm25", 6)))
    assert rollup.state_comparison(rollup.daily_rollup(done.where("false")), everything).count() == 0


def test_the_rollup_groups_no_more_in_a_task_than_it_was_dealt(spark, cleaned):
    one = cleaned({}).drop("site_name", "pm25_cleaned")
    rows = spark.range(0, 8000, 1, 1).crossJoin(F.broadcast(one))  # the scan is one task
    own = rows.selectExpr("*", "concat('s', id) AS site_name", "double(id) AS pm25_cleaned")
    hot = rows.selectExpr("*", "'s' AS site_name", "double(id) AS pm25_cleaned")
    for made in (own, hot):
        plan = rollup.daily_rollup(made)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan[plan.index("partial_count"):]  # rows are dealt before the first grouping
    found = rollup.daily_rollup(hot).collect()
    assert len(found) == 1 and found[0].n == 8000 and found[0].sum_pm25 == sum(range(8000))
    assert rollup.daily_rollup(own).count() == 8000


def test_the_rollup_is_all_that_is_read(spark, year, tmp_path):
    path = rollup.write_rollup(rollup.daily_rollup(cleanup.clean(year)), str(tmp_path / "rollup"))
    pruned = rollup.state_comparison(rollup.read_rollup(spark, path, keep_folders=True),
                                     FilterState((), date(2024, 2, 1), date(2024, 2, 29)))
    text = pruned._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 1 and "PartitionFilters: [" in text and "month" in text.split("PartitionFilters: [")[1][:200]
