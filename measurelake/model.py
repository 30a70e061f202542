"""Schemas, column names and settings shared by every operator.

Operators work on canonical snake_case columns.  :class:`ColumnMap` renames any
measurement table on its way in (and back on its way out), so no operator
carries a literal source column name.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Canonical raw column -> type.
RAW_TYPES: dict[str, T.DataType] = {
    "state_name": T.StringType(),
    "county_name": T.StringType(),
    "date_local": T.DateType(),
    "site_name": T.StringType(),
    "latitude": T.DoubleType(),
    "longitude": T.DoubleType(),
    "sample_duration": T.StringType(),
    "pollutant_standard": T.StringType(),
    "observation_percent": T.DoubleType(),
    "pm25_raw": T.DoubleType(),
    "aqi_raw": T.LongType(),
}

# Canonical columns the cleanup appends after the nine carried over.
CLEANED_TYPES: dict[str, T.DataType] = {
    **{k: v for k, v in RAW_TYPES.items() if k not in ("pm25_raw", "aqi_raw")},
    "pm25_original": T.DoubleType(),
    "aqi_original": T.LongType(),
    "pm25_cleaned": T.DoubleType(),
    "aqi_cleaned": T.DoubleType(),
    "data_quality_flag": T.StringType(),
    "cleanup_action": T.StringType(),
}

RAW_SCHEMA = T.StructType([T.StructField(n, t) for n, t in RAW_TYPES.items()])
CLEANED_SCHEMA = T.StructType([T.StructField(n, t) for n, t in CLEANED_TYPES.items()])

ALL_STATES = "All States"


@dataclass(frozen=True)
class ColumnMap:
    """Source column name for each canonical column; defaults are the raw file's names."""

    state_name: str = "State Name"
    county_name: str = "County Name"
    date_local: str = "Date Local"
    site_name: str = "Local Site Name"
    latitude: str = "Latitude"
    longitude: str = "Longitude"
    sample_duration: str = "Sample Duration"
    pollutant_standard: str = "Pollutant Standard"
    observation_percent: str = "Observation Percent"
    pm25_raw: str = "Arithmetic Mean"
    aqi_raw: str = "AQI"
    pm25_original: str = "pm25_original"
    aqi_original: str = "aqi_original"
    pm25_cleaned: str = "pm25_cleaned"
    aqi_cleaned: str = "aqi_cleaned"
    data_quality_flag: str = "data_quality_flag"
    cleanup_action: str = "cleanup_action"

    def pairs(self) -> dict[str, str]:
        """canonical name -> source name."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def to_canonical(self, df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
        """Keep the mapped columns of ``df`` and give them their canonical names.

        Columns named in ``also`` follow as they are, where present.

        The day becomes a date: compared as a timestamp, the last day of a
        selection would end at its midnight.
        """
        present = set(df.columns)

        def column(name: str, source: str) -> Column:
            found = _quoted(source)
            return (found.cast("date") if name == "date_local" else found).alias(name)

        return df.select(
            *[column(n, s) for n, s in self.pairs().items() if s in present],
            *[_quoted(name) for name in also if name in present],
        )

    def to_source(self, df: DataFrame) -> DataFrame:
        """Rename canonical columns back to the source table's names."""
        names = self.pairs()
        return df.select(*[_quoted(c).alias(names.get(c, c)) for c in df.columns])


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class CleanupConfig:
    """Rules and output settings of the cleanup run."""

    aqi_max: int = 500
    pm25_min: float = 0.0
    pm25_extreme_threshold: float = 150.0
    observation_percent_min: float = 75.0
    null_aqi_strategy: str = "calculate"
    fix_negative_pm25: bool = True
    cap_extreme_aqi: bool = True
    show_examples: bool = True
    example_limit: int = 10
    verbose: bool = True
    export_format: str = "parquet"
    include_cleanup_flags: bool = True
    # Limits of the quality flags around observation_percent_min.
    unreliable_below: float = 50.0
    high_quality_from: float = 90.0

    def __post_init__(self) -> None:
        if self.null_aqi_strategy not in ("calculate", "zero"):
            raise ValueError(f"unknown null_aqi_strategy: {self.null_aqi_strategy!r}")
        if self.export_format not in ("parquet", "csv", "both"):
            raise ValueError(f"unknown export_format: {self.export_format!r}")


@dataclass(frozen=True)
class FilterState:
    """What the user of an analysis has selected.

    ``states`` empty or containing ``"All States"`` selects every state; both
    dates are inclusive, and ``None`` leaves that end open.
    """

    states: tuple[str, ...] = (ALL_STATES,)
    date_from: date | None = date(2024, 1, 1)
    date_to: date | None = date(2024, 12, 31)
    comparison_mode: bool = False
    show_anomalies: bool = False

    @classmethod
    def everything(cls, **changes) -> "FilterState":
        return cls(**{"date_from": None, "date_to": None, **changes})
