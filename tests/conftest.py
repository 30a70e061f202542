from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from measurelake.model import CLEANED_SCHEMA, RAW_SCHEMA  # noqa: E402
from measurelake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4,
        "tests",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__sql__maxMetadataStringLength="5000",
        spark__sql__debug__maxToStringFields="1000",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


RAW_DEFAULTS = dict(
    state_name="A", county_name="c", date_local=date(2024, 1, 1), site_name="s", latitude=1.0,
    longitude=2.0, sample_duration="24 HOUR", pollutant_standard="P", observation_percent=100.0,
    pm25_raw=10.0, aqi_raw=42,
)


@pytest.fixture(scope="session")
def raw(spark):
    """Raw rows from dictionaries; columns left out get harmless values."""

    def make(*rows):
        full = [{**RAW_DEFAULTS, **r} for r in rows]
        return spark.createDataFrame(
            [tuple(r[f.name] for f in RAW_SCHEMA.fields) for r in full], RAW_SCHEMA
        )

    return make


@pytest.fixture(scope="session")
def cleaned(spark):
    """Cleaned rows from dictionaries."""
    defaults = {k: v for k, v in RAW_DEFAULTS.items() if k not in ("pm25_raw", "aqi_raw")}
    defaults.update(pm25_original=10.0, aqi_original=42, pm25_cleaned=10.0, aqi_cleaned=42.0,
                    data_quality_flag="HIGH_QUALITY", cleanup_action="UNCHANGED")

    def make(*rows):
        full = [{**defaults, **r} for r in rows]
        return spark.createDataFrame(
            [tuple(r[f.name] for f in CLEANED_SCHEMA.fields) for r in full], CLEANED_SCHEMA
        )

    return make


@pytest.fixture(scope="session")
def history(spark):
    """Daily history from (state, [(day, pm25), ...]) pairs."""

    def make(**states):
        rows = [(s, d, float(v), 1.0, 1) for s, days in states.items() for d, v in days]
        return spark.createDataFrame(
            rows, "state_name string, date_local date, pm25 double, aqi double, measurements bigint"
        )

    return make


def by(df, *keys):
    """Rows as dictionaries, keyed by one or more columns."""
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict()
            for r in df.collect()}
