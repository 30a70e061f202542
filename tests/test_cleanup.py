from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import by
from measurelake.model import CLEANED_SCHEMA, RAW_SCHEMA, CleanupConfig, FilterState
from measurelake.operators import audit, cleanup, filters
from measurelake.sources.readers import require_schema


def one(df):
    return df.collect()[0].asDict()


def test_schema(raw):
    assert [(f.name, f.dataType) for f in cleanup.clean(raw()).schema.fields] == [
        (f.name, f.dataType) for f in CLEANED_SCHEMA.fields
    ]


def test_missing_concentration_becomes_zero(raw):
    row = one(cleanup.clean(raw({"pm25_raw": None, "aqi_raw": None})))
    assert (row["pm25_cleaned"], row["aqi_cleaned"], row["pm25_original"]) == (0.0, 0.0, None)


@pytest.mark.parametrize(
    "pm25, aqi, action, negative_first",
    [
        (-1.0, None, "AQI_CALCULATED", "NEGATIVE_FIXED"),
        (-1.0, 10, "NEGATIVE_FIXED", "NEGATIVE_FIXED"),
        (151.0, 501, "AQI_CAPPED", "AQI_CAPPED"),
        (151.0, 500, "EXTREME_PM25", "UNCHANGED"),
        (150.0, 500, "UNCHANGED", "UNCHANGED"),
        (10.0, None, "AQI_CALCULATED", "AQI_CALCULATED"),
        (None, 10, "UNCHANGED", "PM25_NULL_REPLACED"),
        (None, None, "AQI_CALCULATED", "PM25_NULL_REPLACED"),
    ],
)
def test_action_precedence(raw, pm25, aqi, action, negative_first):
    df = raw({"pm25_raw": pm25, "aqi_raw": aqi})
    assert one(cleanup.clean(df))["cleanup_action"] == action
    assert one(cleanup.clean(df, negative_first=True))["cleanup_action"] == negative_first


@pytest.mark.parametrize(
    "seen, flag",
    [(49.9, "UNRELIABLE"), (50.0, "LOW_QUALITY"), (74.9, "LOW_QUALITY"), (75.0, "ACCEPTABLE"),
     (89.9, "ACCEPTABLE"), (90.0, "HIGH_QUALITY"), (None, "HIGH_QUALITY")],
)
def test_quality_flag(raw, seen, flag):
    assert one(cleanup.clean(raw({"observation_percent": seen})))["data_quality_flag"] == flag


def test_config_switches(raw):
    df = raw({"pm25_raw": -3.0, "aqi_raw": None}, {"pm25_raw": 20.0, "aqi_raw": 900})
    zero = cleanup.clean(df, CleanupConfig(null_aqi_strategy="zero")).collect()
    assert [r.aqi_cleaned for r in zero] == [0.0, 500.0]
    loose = cleanup.clean(df, CleanupConfig(fix_negative_pm25=False, cap_extreme_aqi=False)).collect()
    assert [(r.pm25_cleaned, r.aqi_cleaned) for r in loose] == [(-3.0, 0.0), (20.0, 900.0)]
    tight = cleanup.clean(df, CleanupConfig(aqi_max=300, pm25_min=1.0)).collect()
    assert [(r.pm25_cleaned, r.aqi_cleaned) for r in tight] == [(1.0, 4.0), (20.0, 300.0)]
    with pytest.raises(ValueError):
        CleanupConfig(null_aqi_strategy="guess")
    with pytest.raises(ValueError):
        CleanupConfig(export_format="xml")


MIXED = [
    {"pm25_raw": -7.06, "aqi_raw": None, "observation_percent": 10.0},
    {"pm25_raw": 833.84, "aqi_raw": 1513, "county_name": "d"},
    {"pm25_raw": 6.04, "aqi_raw": 34, "site_name": None},
    {"pm25_raw": None, "aqi_raw": None, "pollutant_standard": None, "observation_percent": None},
    {"pm25_raw": 20.0, "aqi_raw": -2, "state_name": None, "observation_percent": 80.0},
    {"pm25_raw": 7.0, "aqi_raw": 30, "state_name": "B", "date_local": date(2024, 12, 31)},
]


def test_cleanup_is_idempotent(raw):
    first = cleanup.clean(raw(*MIXED))
    again = first.drop("pm25_original", "aqi_original", "data_quality_flag", "cleanup_action")
    again = again.withColumnRenamed("pm25_cleaned", "pm25_raw").withColumn(
        "aqi_raw", F.col("aqi_cleaned").cast("bigint")
    )
    second = cleanup.clean(again)
    values = ["pm25_cleaned", "aqi_cleaned"]
    assert sorted(map(tuple, first.select(values).collect())) == sorted(
        map(tuple, second.select(values).collect())
    )
    assert second.where("cleanup_action in ('NEGATIVE_FIXED', 'AQI_CAPPED', 'AQI_CALCULATED')").count() == 0


def test_audit_figures(raw):
    row = one(audit.quality_audit(raw(*MIXED)))
    assert list(row) == audit.AUDIT_BEFORE
    expected = dict(
        total_rows=6, null_state=1, null_pm25=1, null_aqi=2, null_standard=1, null_site=1,
        negative_pm25=1, extreme_pm25=1, negative_aqi=1, extreme_aqi=1, unreliable_obs=1,
        low_quality_obs=0, acceptable_obs=1, high_quality_obs=3, avg_pm25=171.96, median_pm25=7.0,
        min_pm25=-7.06, max_pm25=833.84, avg_aqi=393.75, median_aqi=32.0, min_aqi=-2, max_aqi=1513,
        earliest_date=date(2024, 1, 1), latest_date=date(2024, 12, 31), unique_states=2,
        unique_counties=2,
    )
    assert row == expected


def test_after_cleanup_nothing_is_left(raw):
    done = cleanup.clean(raw(*MIXED))
    after = one(audit.quality_audit_after(done))
    assert [after[c] for c in audit.COUNTS_AFTER] == [0] * 5
    assert after["total_rows"] == 6 and after["max_aqi"] == 500.0 and after["min_pm25"] == 0.0
    success = one(audit.cleanup_success(done))
    assert success == {"problems_identified": 4, "problems_fixed": 4, "problems_remaining": 0,
                       "success_rate": 100.0, "verdict": "PERFEKT"}
    sides = by(audit.before_after(done), "status")
    assert sides["VORHER"]["null_aqi"] == 2 and sides["NACHHER"]["null_aqi"] == 0
    assert sides["VORHER"]["max_aqi"] == 1513.0 and sides["NACHHER"]["max_aqi"] == 500.0


def test_success_when_rules_are_off(raw):
    config = CleanupConfig(fix_negative_pm25=False, cap_extreme_aqi=False)
    row = one(audit.cleanup_success(cleanup.clean(raw(*MIXED), config), config))
    assert row["problems_remaining"] == 2 and row["success_rate"] == 50.0
    assert row["verdict"] == "WARNUNG"


def test_empty_table(raw):
    empty = raw().where("false")
    row = one(audit.quality_audit(empty))
    assert row["total_rows"] == 0 and row["null_aqi"] == 0 and row["avg_pm25"] is None
    assert row["median_aqi"] is None and row["unique_states"] == 0
    done = cleanup.clean(empty)
    assert one(audit.cleanup_success(done))["success_rate"] == 100.0
    metrics = one(audit.data_quality_metrics(done))
    assert metrics["quality_score"] == 0.0 and metrics["total_records"] == 0
    assert audit.problem_examples(empty).count() == 0
    assert all(r.rows == 0 for r in audit.problem_counts(empty).collect())


def test_shares_and_order(raw):
    rows = [{"aqi_raw": None}] * 3 + [{"observation_percent": 10.0}]
    done = cleanup.clean(raw(*rows))
    assert [tuple(r) for r in cleanup.cleanup_summary(done).collect()] == [
        ("AQI_CALCULATED", 3, 75.0), ("UNCHANGED", 1, 25.0)]
    assert [r[0] for r in cleanup.quality_distribution(done).collect()] == ["HIGH_QUALITY", "UNRELIABLE"]


def test_problem_examples(raw):
    many = raw(*[{"pm25_raw": -float(i), "aqi_raw": None if i % 2 else 900} for i in range(1, 60)])
    config = CleanupConfig(example_limit=7)
    rows = audit.problem_examples(many, config).collect()
    counts = {}
    for r in rows:
        counts[r.problem] = counts.get(r.problem, 0) + 1
    assert counts == {"NULL_AQI": 7, "NEGATIVE_PM25": 7, "EXTREME_AQI": 7}
    assert all(r.aqi_raw is None and r.sample_duration is not None
               for r in rows if r.problem == "NEGATIVE_PM25")
    assert all(r.pm25_raw < 0 for r in rows)
    same = audit.problem_examples(many.repartition(9), config).collect()
    assert sorted(map(str, rows)) == sorted(map(str, same))
    text = audit.problem_examples(many, config, portable=True).collect()
    assert len(text) == len(rows) and all(r.pm25_raw < 0 for r in text)
    other = audit.problem_examples(many, config, seed=1).collect()
    assert sorted(map(str, rows)) != sorted(map(str, other))


def test_quality_metrics(cleaned):
    rows = [{"pm25_cleaned": 10.0}] * 40 + [{"pm25_cleaned": 500.0, "pm25_original": -1.0}] + [
        {"pm25_cleaned": None}] * 9
    row = one(audit.data_quality_metrics(cleaned(*rows)))
    assert (row["total_records"], row["null_count"], row["negative_count"], row["outlier_count"]) == (
        50, 9, 1, 1)
    assert row["completeness_score"] == pytest.approx(82.0)
    assert row["quality_score"] == pytest.approx(100 - (9 * 20 + 1 * 20 + 1 * 10) / 50)


def test_report_sections(raw):
    rows = audit.cleanup_report(cleanup.clean(raw(*MIXED))).collect()
    values = {(r.section, r.key): r.value for r in rows}
    assert values["CONFIGURATION", "aqi_max"] == "500"
    assert values["STATISTICS BEFORE", "max_aqi"] == "1513"
    assert values["STATISTICS AFTER", "max_aqi"] == "500.0"
    assert len([1 for r in rows if r.section == "STATISTICS BEFORE"]) == 26
    assert len([1 for r in rows if r.section == "STATISTICS AFTER"]) == 14


def test_raw_row_queries(raw):
    df = raw({"aqi_raw": 1513}, {"aqi_raw": 593}, {"aqi_raw": 301}, {"aqi_raw": 300},
             {"pm25_raw": -7.06, "aqi_raw": None, "state_name": "B"})
    capped = {r.aqi_original: (r.aqi_capped, r.amount_capped, r.category)
              for r in audit.aqi_capping(df).collect()}
    assert capped == {1513: (500, 1013, "SENSOR ERROR"), 593: (500, 93, "Capped"),
                      301: (301, 0, "Normal")}
    assert audit.extreme_aqi_rows(df).count() == 2
    fixed = audit.negative_corrections(df).collect()
    assert [(r.pm25_original, r.pm25_fixed, r.correction) for r in fixed] == [(-7.06, 0.0, 7.06)]
    assert audit.most_negative(df).collect()[0].pm25_raw == -7.06
    quality = audit.state_quality(df).collect()
    assert [(r.state_name, r.null_aqi_pct) for r in quality] == [("B", 100.0), ("A", 0.0)]
    status = {r.status for r in audit.aqi_fill_status(df).collect()}
    assert status == {"Berechnet", "Original"}


def test_filters(cleaned):
    df = cleaned(
        {"state_name": "A", "date_local": date(2024, 1, 1)},
        {"state_name": "B", "date_local": date(2024, 12, 31)},
        {"state_name": "C", "date_local": date(2023, 12, 31)},
        {"state_name": None, "date_local": date(2024, 5, 1)},
    )
    states = lambda d: sorted(r.state_name or "" for r in d.collect())
    assert states(filters.apply_filter(df, FilterState())) == ["", "A", "B"]
    assert states(filters.apply_filter(df, FilterState(("A", "C")))) == ["A"]
    assert states(filters.apply_filter(df, FilterState(("A", "All States")))) == ["", "A", "B"]
    assert states(filters.apply_filter(df, FilterState(()))) == ["", "A", "B"]
    assert states(filters.apply_filter(df, FilterState.everything())) == ["", "A", "B", "C"]
    tricky = "x'; DROP TABLE y; --"
    assert states(filters.in_states(df, [tricky])) == []
    assert [r.state_name for r in filters.states_list(df).collect()] == ["A", "B", "C"]


def test_search_before_limit(cleaned):
    rows = [{"site_name": f"site {i:03d}"} for i in range(50)] + [{"site_name": "Zürich (West)"}]
    df = cleaned(*rows)
    everything = FilterState.everything()
    found = filters.explorer_rows(df, everything, limit=5, term="zÜrich|SITE 04[89]")
    assert sorted(r.site_name for r in found.collect()) == ["Zürich (West)", "site 048", "site 049"]
    assert filters.search(df, "(west)", literal=True).count() == 1
    assert filters.search(df, "2024-01-01").count() == 51
    assert filters.explorer_rows(df, everything, limit=7).count() == 7
    nulls = cleaned({"site_name": None, "pollutant_standard": None})
    assert filters.search(nulls, "none|nan|null").count() == 0


def test_schema_check(raw):
    assert require_schema(raw(), RAW_SCHEMA) is not None
    with pytest.raises(TypeError, match="aqi_raw"):
        require_schema(raw().withColumn("aqi_raw", F.lit("x")), RAW_SCHEMA)
    with pytest.raises(TypeError, match="no such column"):
        require_schema(raw().drop("latitude"), RAW_SCHEMA)
