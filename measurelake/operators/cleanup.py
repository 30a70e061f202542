"""Row-level cleanup as one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelake.functions.scalar import aqi_from_pm25, percent_of, round_half_up
from measurelake.model import CleanupConfig

# Quality flags, best first.
QUALITY_ORDER = ["HIGH_QUALITY", "ACCEPTABLE", "LOW_QUALITY", "UNRELIABLE"]

_CARRIED = [
    "state_name",
    "county_name",
    "date_local",
    "site_name",
    "latitude",
    "longitude",
    "sample_duration",
    "pollutant_standard",
    "observation_percent",
]


def fixed_pm25(config: CleanupConfig) -> Column:
    """Concentration with negatives raised to the minimum.

    ``greatest`` skips nulls, so a missing concentration becomes the minimum too.
    """
    raw = F.col("pm25_raw")
    return F.greatest(raw, F.lit(float(config.pm25_min))) if config.fix_negative_pm25 else raw


def fixed_aqi(config: CleanupConfig) -> Column:
    """Index filled where missing, capped, and never negative."""
    if config.null_aqi_strategy == "calculate":
        fill = aqi_from_pm25(fixed_pm25(config))
    else:
        fill = F.lit(0.0)
    aqi = F.coalesce(F.col("aqi_raw").cast("double"), fill)
    if config.cap_extreme_aqi:
        aqi = F.least(aqi, F.lit(float(config.aqi_max)))
    return F.greatest(aqi, F.lit(0.0))


def quality_flag(config: CleanupConfig) -> Column:
    """Flag by observation percent; a missing percent counts as high quality."""
    seen = F.col("observation_percent")
    return (
        F.when(seen < config.unreliable_below, "UNRELIABLE")
        .when(seen < config.observation_percent_min, "LOW_QUALITY")
        .when(seen < config.high_quality_from, "ACCEPTABLE")
        .otherwise("HIGH_QUALITY")
    )


def cleanup_action(config: CleanupConfig, negative_first: bool = False) -> Column:
    """Label of the first rule that applies to a row.

    The default order puts a missing index first.  ``negative_first`` is the
    order of the written exercises: missing concentration, negative, capped,
    calculated, and no class for extreme concentrations.
    """
    missing_aqi = F.col("aqi_raw").isNull()
    negative = F.col("pm25_raw") < 0
    capped = F.col("aqi_raw") > config.aqi_max
    if negative_first:
        return (
            F.when(F.col("pm25_raw").isNull(), "PM25_NULL_REPLACED")
            .when(negative, "NEGATIVE_FIXED")
            .when(capped, "AQI_CAPPED")
            .when(missing_aqi, "AQI_CALCULATED")
            .otherwise("UNCHANGED")
        )
    return (
        F.when(missing_aqi, "AQI_CALCULATED")
        .when(negative, "NEGATIVE_FIXED")
        .when(capped, "AQI_CAPPED")
        .when(F.col("pm25_raw") > config.pm25_extreme_threshold, "EXTREME_PM25")
        .otherwise("UNCHANGED")
    )


def clean(
    df: DataFrame, config: CleanupConfig = CleanupConfig(), negative_first: bool = False
) -> DataFrame:
    """Cleaned table of a raw table: carried columns, originals, cleaned values, labels."""
    return df.select(
        *_CARRIED,
        F.col("pm25_raw").alias("pm25_original"),
        F.col("aqi_raw").alias("aqi_original"),
        round_half_up(fixed_pm25(config), 2).alias("pm25_cleaned"),
        round_half_up(fixed_aqi(config), 0).alias("aqi_cleaned"),
        quality_flag(config).alias("data_quality_flag"),
        cleanup_action(config, negative_first).alias("cleanup_action"),
    )


def originals(cleaned: DataFrame) -> DataFrame:
    """The raw table a cleaned table with tracking columns was made from."""
    return cleaned.select(
        *_CARRIED,
        F.col("pm25_original").alias("pm25_raw"),
        F.col("aqi_original").alias("aqi_raw"),
    )


def share_by(
    df: DataFrame, label: str, digits: int = 2, rows: str | None = None
) -> DataFrame:
    """Rows and percent of all rows per value of a label column.

    ``rows`` names a column that says how many rows a row stands for.  The total
    is a window over the already counted labels, a handful of rows.
    """
    number = F.sum(rows) if rows else F.count(F.lit(1))
    counted = df.groupBy(label).agg(number.alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counted.withColumn("percent", percent_of(F.col("count"), total, digits))


def cleanup_summary(cleaned: DataFrame, rows: str | None = None) -> DataFrame:
    """Rows per cleanup action, most frequent first; ``rows`` as for :func:`share_by`."""
    return share_by(cleaned, "cleanup_action", rows=rows).orderBy(F.desc("count"), "cleanup_action")


def quality_distribution(cleaned: DataFrame, rows: str | None = None) -> DataFrame:
    """Rows per quality flag, best first; ``rows`` as for :func:`share_by`."""
    rank = F.array_position(F.array(*[F.lit(q) for q in QUALITY_ORDER]), F.col("data_quality_flag"))
    return share_by(cleaned, "data_quality_flag", rows=rows).orderBy(rank)
