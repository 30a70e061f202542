from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import by
from measurelake.model import CLEANED_SCHEMA, RAW_SCHEMA, CleanupConfig, ColumnMap, FilterState
from measurelake.operators import audit, cleanup, filters
from measurelake.plans import pipeline
from measurelake.sources import readers, writers

# A file as published: other columns in between, another column order.
CSV = """State Code,AQI,State Name,County Name,Date Local,Arithmetic Mean,Local Site Name,Latitude,Longitude,Sample Duration,Pollutant Standard,Observation Percent,Method Name
06,34,California,Alameda,2024-01-01,6.04,"Oak, West",37.7,-122.2,24 HOUR,PM25 24-hour 2012,100.0,x
06,,California,Alameda,2024-01-02,-7.06,,37.7,-122.2,1 HOUR,,40.0,x
25,1513,Massachusetts,Essex,2024-11-10,833.84,Lynn,42.4,-70.9,24 HOUR,PM25 24-hour 2012,80.0,x
"""


@pytest.fixture()
def csv(tmp_path):
    path = tmp_path / "daily.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_is_read_by_name(spark, csv):
    df = readers.read_csv(spark, csv)
    assert set(df.columns) == set(RAW_SCHEMA.names)
    readers.require_schema(df, RAW_SCHEMA)
    rows = by(df, "date_local")
    assert rows[date(2024, 1, 1)]["site_name"] == "Oak, West" and rows[date(2024, 1, 1)]["aqi_raw"] == 34
    gap = rows[date(2024, 1, 2)]
    assert gap["aqi_raw"] is None and gap["site_name"] is None and gap["pm25_raw"] == -7.06
    assert df.select("pm25_raw").agg(F.sum("pm25_raw")).collect()[0][0] == pytest.approx(832.82)


def test_csv_files_with_another_layout_fail(spark, tmp_path):
    header, first, *_ = CSV.splitlines()
    (tmp_path / "a.csv").write_text(f"{header}\n{first}\n")
    swapped = header.replace("State Name,County Name", "County Name,State Name")
    (tmp_path / "b.csv").write_text(f"{swapped}\n{first}\n")
    with pytest.raises(Exception, match="CSV header"):
        readers.read_csv(spark, str(tmp_path)).collect()


def test_bad_cells_fail_unless_permitted(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(CSV.replace("833.84", "n/a"))
    with pytest.raises(Exception):
        readers.read_csv(spark, str(path)).collect()
    rows = readers.read_csv(spark, str(path), mode="PERMISSIVE").collect()
    assert [r.pm25_raw for r in rows if r.aqi_raw == 1513] == [None]


def test_other_column_names(spark, tmp_path):
    columns = ColumnMap(state_name="land", pm25_raw="feinstaub")
    df = spark.createDataFrame([("Hessen", 4.0)], "land string, feinstaub double")
    path = str(tmp_path / "t")
    df.write.parquet(path)
    got = readers.read_parquet(spark, path, columns)
    assert got.columns == ["state_name", "pm25_raw"]
    assert columns.to_source(got).columns == ["land", "feinstaub"]


def test_timestamps_become_days(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select timestamp_ntz'2024-12-31 10:00:00' as `Date Local`, 'A' as `State Name`").write.parquet(path)
    df = readers.read_parquet(spark, path)
    assert dict(df.dtypes)["date_local"] == "date"
    assert filters.apply_filter(df, FilterState()).count() == 1


def test_first_available(spark, csv, tmp_path):
    missing = str(tmp_path / "none.parquet")
    assert readers.read_first_available(spark, [missing, csv]).count() == 3
    with pytest.raises(FileNotFoundError, match="none.parquet"):
        readers.read_first_available(spark, [missing])


def test_schema_profile(spark, csv):
    rows = by(readers.schema_profile(readers.read_csv(spark, csv), ["aqi_raw", "date_local"]), "column_name")
    assert rows["aqi_raw"] == {"column_name": "aqi_raw", "column_type": "bigint", "non_null_rows": 2}
    assert rows["date_local"]["column_type"] == "date"
    empty = readers.schema_profile(readers.read_csv(spark, csv).where("false"), ["aqi_raw"]).collect()[0]
    assert (empty.column_type, empty.non_null_rows) == ("bigint", 0)


@pytest.mark.parametrize("flags", [True, False])
@pytest.mark.parametrize("by_month", [True, False])
def test_export_roundtrip(spark, csv, tmp_path, flags, by_month):
    done = cleanup.clean(readers.read_csv(spark, csv))
    config = CleanupConfig(export_format="both", include_cleanup_flags=flags)
    paths = writers.export_cleaned(done, str(tmp_path / "out"), config, by_month=by_month)
    assert set(paths) == {"parquet", "csv"}
    want = writers.export_projection(done, flags)
    parquet = readers.read_parquet(spark, paths["parquet"])
    rows = lambda d: sorted(map(str, d.select(*want.columns).collect()))
    assert rows(parquet) == rows(want)
    text = spark.read.option("header", True).csv(paths["csv"])
    assert text.count() == 3 and "year" not in text.columns
    assert ("pm25_original" in text.columns) is flags and ("Arithmetic Mean" in text.columns) is not flags
    size = writers.output_size(spark, paths["parquet"]).collect()[0]
    assert size.files >= 1 and size.size_mb > 0


def test_month_folders_prune(spark, csv, tmp_path):
    done = cleanup.clean(readers.read_csv(spark, csv))
    path = writers.write_parquet(done, str(tmp_path / "m"), "date_local")
    df = spark.read.parquet(path).where("year = 2024 and month = 11")
    assert "PartitionFilters: [isnotnull(year" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1


def test_pipeline(spark, csv, tmp_path):
    run = pipeline.custom_run(spark, csv, str(tmp_path / "run"), {"export_format": "both", "example_limit": 1})
    assert set(run.paths) == {"parquet", "csv", "report"}
    both = run.audit.collect()[0]
    assert (both.total_rows, both.before_null_aqi, both.after_null_aqi) == (3, 1, 0)
    assert both.before_max_aqi == 1513 and both.after_max_aqi == 500.0
    assert run.success.collect()[0].success_rate == 100.0
    assert by(run.comparison, "status")["NACHHER"]["min_pm25"] == 0.0
    assert {r.problem for r in run.examples.collect()} == {
        "NULL_AQI", "NEGATIVE_PM25", "EXTREME_AQI", "EXTREME_PM25", "LOW_OBSERVATION"}
    assert spark.table("cleaned_data").count() == 3
    readers.require_schema(run.cleaned, CLEANED_SCHEMA)
    lines = [r.value for r in spark.read.text(run.paths["report"]).collect()]
    assert "STATISTICS BEFORE  total_rows: 3" in lines and "CONFIGURATION  aqi_max: 500" in lines
    assert run.sizes["csv"].collect()[0].size_mb > 0
    # Validation reads the audit of the export, not the source.
    assert all("_cleaned.parquet" in f for f in run.cleaned.inputFiles())
    assert "_audit.parquet" in run.success._jdf.queryExecution().executedPlan().toString()


def test_quick_run_without_tracking(spark, csv, tmp_path):
    run = pipeline.quick_run(spark, csv, str(tmp_path / "q"), verbose=False, show_examples=False)
    assert set(run.paths) == {"parquet"} and run.examples is None and run.schema is None
    config = {"include_cleanup_flags": False, "export_format": "csv", "verbose": False}
    slim = pipeline.custom_run(spark, csv, str(tmp_path / "s"), config)
    assert slim.success.collect()[0].problems_identified == 3


@pytest.mark.parametrize("tracking", [True, False])
@pytest.mark.parametrize("export_format", ["parquet", "csv", "both"])
def test_run_reads_its_source_once(spark, csv, tmp_path, export_format, tracking):
    config = CleanupConfig(export_format=export_format, include_cleanup_flags=tracking, example_limit=2)
    run = pipeline.run_cleanup(spark, csv, str(tmp_path / "run"), config)
    wanted = {"parquet", "csv"} if export_format == "both" else {export_format}
    assert set(run.paths) == {*wanted, "report"}

    def scanned(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        return text.split("Initial Plan")[0].count("FileScan")

    # Whatever is read later: small tables for the figures, the tracking table for examples.
    for df in (run.audit, run.comparison, run.success, run.summary, run.quality, run.schema):
        files = df.inputFiles()
        assert files and all("_audit" in f for f in files) and scanned(df) == 1
    assert scanned(run.examples) == 2 and not any(f.endswith(".csv") for f in run.examples.inputFiles())
    assert scanned(audit.audit_parts(run.cleaned, config)) == 1
    run_medians = audit.both_medians(run.cleaned)
    run_medians.collect()
    assert scanned(run_medians) <= 2  # none is shown where the stage that read was replaced
    inputs = run.cleaned.inputFiles()
    assert all(("_cleaned.parquet" if "tracking" not in run.working else "_tracking.parquet") in f for f in inputs)

    # The same figures as computed from the source.
    done = cleanup.clean(readers.read_csv(spark, csv), config)
    assert run.audit.collect() == audit.audit_both(done, config, medians=True).collect()
    assert run.comparison.collect() == audit.before_after(done, config).collect()
    assert run.success.collect() == audit.cleanup_success(done, config).collect()
    assert run.summary.collect() == cleanup.cleanup_summary(done).collect()
    assert run.quality.collect() == cleanup.quality_distribution(done).collect()
    profile = readers.schema_profile(cleanup.originals(done), [r.column_name for r in run.schema.collect()])
    assert run.schema.collect() == profile.collect()


def test_working_path_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert writers.working_path(spark, "x").startswith(shared)


def test_cleanup_runs_on_a_stream(spark, raw, tmp_path):
    raw({"aqi_raw": None}, {"pm25_raw": -1.0}).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RAW_SCHEMA).parquet(str(tmp_path / "in"))
    query = (
        cleanup.clean(stream).writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    actions = {r.cleanup_action for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert actions == {"AQI_CALCULATED", "NEGATIVE_FIXED"}


ODD = ['Near ""Road"" I-25, N', 'say "hi", twice', "  padded  ", "", None, "back\\slash", "comma, blank ", '"']


def test_csv_keeps_quotes_blanks_and_empty_text(spark, raw, tmp_path):
    df = raw(*[{"site_name": s, "pm25_raw": float(i)} for i, s in enumerate(ODD)])
    path = writers.write_csv(ColumnMap().to_source(df), str(tmp_path / "odd"))
    got = {int(r.pm25_raw): r.site_name for r in readers.read_csv(spark, path).collect()}
    assert got == dict(enumerate(ODD))


def test_csv_line_breaks_need_multiline(spark, raw, tmp_path):
    df = raw({"site_name": "two\nlines", "pm25_raw": 1.0}, {"site_name": "one", "pm25_raw": 2.0})
    path = writers.write_csv(ColumnMap().to_source(df), str(tmp_path / "breaks"))
    got = {r.pm25_raw: r.site_name for r in readers.read_csv(spark, path, multiline=True).collect()}
    assert got == {1.0: "two\nlines", 2.0: "one"}


def test_dates_prune_month_folders(spark, cleaned, tmp_path):
    days = [date(2024, 1, 5), date(2024, 2, 5), date(2024, 3, 5), date(2025, 2, 5)]
    paths = writers.export_cleaned(cleaned(*[{"date_local": d} for d in days]), str(tmp_path / "m"), by_month=True)
    df = readers.read_parquet(spark, paths["parquet"], keep_folders=True)
    one = filters.apply_filter(df, FilterState(None, date(2024, 2, 1), date(2024, 2, 28)))
    assert [r.date_local for r in one.collect()] == [days[1]]
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in text and "month" in text.split("PartitionFilters:")[1]
    assert len(one.inputFiles()) <= 4 and one.select("date_local").count() == 1


def test_working_path_needs_the_shared_folder(spark):
    class Unset:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError):
        writers.working_path(Unset(), "x")
