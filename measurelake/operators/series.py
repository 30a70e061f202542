"""Daily series per state, and the window operators over them.

Readings are reduced to one row per state and day before anything is
partitioned by state alone.  A state's partition is then bounded by the
calendar (365 rows per year) and not by its readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelake.functions.scalar import divide, round_half_up
from measurelake.model import FilterState
from measurelake.operators.filters import in_states


def _by_day() -> Window:
    return Window.partitionBy("state_name").orderBy("date_local")


def daily_state(
    df: DataFrame, null_policy: str = "zero", round_daily: int = 2, value: str = "pm25_cleaned"
) -> DataFrame:
    """Mean concentration per state and day.

    ``pm25`` is rounded, and later steps (changes, rolling means, scores) work on
    the rounded figure; ``pm25_exact`` is the unrounded mean.  ``null_policy``
    counts missing readings as zero (``"zero"``) or leaves them out (``"skip"``).
    """
    reading = F.col(value)
    if null_policy == "zero":
        reading = F.greatest(F.coalesce(reading, F.lit(0.0)), F.lit(0.0))
    elif null_policy != "skip":
        raise ValueError(f"unknown null_policy: {null_policy!r}")
    return (
        df.groupBy("state_name", "date_local")
        .agg(F.avg(reading).alias("pm25_exact"), F.count(F.lit(1)).alias("n"))
        .select(
            "state_name",
            "date_local",
            round_half_up(F.col("pm25_exact"), round_daily).alias("pm25"),
            "pm25_exact",
            "n",
        )
    )


def alarm_days(
    cleaned: DataFrame,
    states: Sequence[str] | None = None,
    above: float = 100.0,
    critical_above: float = 200.0,
    limit: int | None = 100,
) -> DataFrame:
    """Days whose mean rose by more than ``above`` percent on the previous day on record."""
    daily = daily_state(in_states(cleaned, states))
    today, before = F.col("heute"), F.col("gestern")
    change = divide(today - before, before) * 100.0
    out = (
        daily.select(
            "state_name",
            "date_local",
            F.col("pm25").alias("heute"),
            F.lag("pm25").over(_by_day()).alias("gestern"),
        )
        .where((before > 0) & (change > above))
        .select(
            "state_name",
            "date_local",
            "heute",
            "gestern",
            round_half_up(change, 1).alias("prozent_change"),
            F.when(change > critical_above, "KRITISCH").otherwise("WARNUNG").alias("alarm_level"),
        )
    )
    if limit is None:
        return out
    return out.orderBy(
        F.desc("prozent_change"), F.asc_nulls_last("state_name"), "date_local"
    ).limit(limit)


def alarm_summary(alarms: DataFrame) -> DataFrame:
    """Alarms per level, highest rise, and states concerned, of :func:`alarm_days`."""
    return alarms.agg(
        F.count_if(F.col("alarm_level") == "KRITISCH").alias("kritisch"),
        F.count_if(F.col("alarm_level") == "WARNUNG").alias("warnung"),
        F.max("prozent_change").alias("max_change"),
        F.countDistinct("state_name").alias("affected_states"),
    )


def worst_days(
    cleaned: DataFrame, states: Sequence[str] | None = None, top: int = 3, jump_above: float = 20.0
) -> DataFrame:
    """The ``top`` worst days per state, their jump and their excess over the mean day.

    The previous day is looked up before ranking: the rank filter then is a
    group limit, applied before the rows are ordered.
    """
    daily = daily_state(in_states(cleaned, states))
    worst_first = Window.partitionBy("state_name").orderBy(F.desc_nulls_last("pm25_exact"), "date_local")
    # One row: the mean of all daily means.
    overall = daily.agg(round_half_up(F.avg("pm25"), 2).alias("us_avg"))
    jump = F.col("pm25") - F.coalesce("vortag", "pm25")
    return (
        daily.withColumn("vortag", F.lag("pm25").over(_by_day()))
        .withColumn("rang", F.row_number().over(worst_first))
        .where(F.col("rang") <= top)
        .crossJoin(F.broadcast(overall))
        .select(
            "state_name",
            "date_local",
            "pm25",
            F.col("rang").cast("bigint").alias("rang"),
            "vortag",
            round_half_up(jump, 2).alias("sprung"),
            round_half_up(F.col("pm25") - F.col("us_avg"), 2).alias("ueber_durchschnitt"),
            F.when(jump > jump_above, "Plötzlich").otherwise("Normal").alias("sprung_typ"),
        )
        .orderBy(F.asc_nulls_last("state_name"), "rang")
    )


def worst_days_summary(worst: DataFrame) -> DataFrame:
    """Highest day and its state, sudden jumps, and mean excess, of :func:`worst_days`."""
    return worst.agg(
        F.max("pm25").alias("max_pm25"),
        F.min_by("state_name", F.struct(-F.col("pm25"), "state_name")).alias("max_state"),
        F.count_if(F.col("sprung_typ") == "Plötzlich").alias("sudden_jumps"),
        round_half_up(F.avg("ueber_durchschnitt"), 4).alias("avg_excess"),
    )


def trailing_mean(value: str, window: int, keys: Sequence[str], order: str,
                  full_window: bool = False) -> Column:
    """Mean of the last ``window`` rows; null before ``window`` rows if ``full_window``."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), Window.currentRow)
    mean = F.avg(value).over(frame)
    return F.when(F.count(value).over(frame) == window, mean) if full_window else mean


def rolling_average(
    cleaned: DataFrame, states: Sequence[str] | None = None, window: int = 7
) -> DataFrame:
    """Daily mean, trailing mean, and which side of it the day is on, for every state."""
    daily = daily_state(in_states(cleaned, states))
    mean = trailing_mean("pm25", window, ["state_name"], "date_local")
    return daily.select(
        "state_name",
        "date_local",
        F.col("pm25").alias("daily_pm25"),
        round_half_up(mean, 2).alias("rolling_7day"),
        F.when(F.col("pm25") > mean, "Über Trend").otherwise("Unter Trend").alias("trend_position"),
    )


def rolling_summary(rolling: DataFrame) -> DataFrame:
    """Mean day, highest trailing mean, days above and below, per state."""
    return rolling.groupBy("state_name").agg(
        round_half_up(F.avg("daily_pm25"), 2).alias("avg_daily"),
        F.max("rolling_7day").alias("max_rolling"),
        F.count_if(F.col("trend_position") == "Über Trend").alias("days_above"),
        F.count_if(F.col("trend_position") == "Unter Trend").alias("days_below"),
    )


def good_air_streaks(
    cleaned: DataFrame, below: float = 12.0, top_n: int | None = 10
) -> DataFrame:
    """Longest runs of consecutive calendar days with a mean below ``below``, per state.

    A good day's date minus its number among the good days is constant within a
    run.  Equally long runs of a state are all kept.
    """
    good = daily_state(cleaned, null_policy="skip").where(F.col("pm25_exact") < below)
    number = F.row_number().over(_by_day())
    runs = (
        good.select("state_name", "date_local", F.date_sub("date_local", number).alias("_run"))
        .groupBy("state_name", "_run")
        .agg(
            F.min("date_local").alias("streak_start"),
            F.max("date_local").alias("streak_end"),
            F.count(F.lit(1)).alias("tage"),
        )
    )
    longest = Window.partitionBy("state_name").orderBy(F.desc("tage"))
    out = (
        runs.withColumn("state_rank", F.rank().over(longest).cast("bigint"))
        .where(F.col("state_rank") == 1)
        .select("state_name", "streak_start", "streak_end", "tage", "state_rank")
    )
    if top_n is None:
        return out
    return out.orderBy(F.desc("tage"), F.asc_nulls_last("state_name"), "streak_start").limit(top_n)


def zscore_anomalies(
    cleaned: DataFrame, states: Sequence[str] | None = None, limit: int | None = 100
) -> DataFrame:
    """Standard score of each day within its state, most unusual first."""
    daily = daily_state(in_states(cleaned, states), null_policy="skip")
    own = Window.partitionBy("state_name")
    score = divide(F.col("pm25") - F.col("_mean"), F.col("_std"))
    size = F.abs(score)
    out = (
        daily.withColumn("_mean", F.avg("pm25").over(own))
        .withColumn("_std", F.stddev_samp("pm25").over(own))
        .where(F.col("_std") > 0)
    )
    if limit is not None:
        out = out.orderBy(
            size.desc_nulls_last(), F.asc_nulls_last("state_name"), "date_local"
        ).limit(limit)
    return out.select(
        "state_name",
        "date_local",
        "pm25",
        round_half_up(F.col("_mean"), 2).alias("state_avg"),
        round_half_up(F.col("_std"), 2).alias("state_stddev"),
        round_half_up(score, 2).alias("z_score"),
        F.when(size > 3, "Extreme Anomalie")
        .when(size > 2, "Starke Anomalie")
        .when(size > 1.5, "Leichte Anomalie")
        .otherwise("Normal")
        .alias("anomaly_level"),
    )


def centered_mean(
    series: DataFrame, value: str = "avg_pm25", order: str = "month",
    keys: Sequence[str] = (), name: str = "ma3",
) -> DataFrame:
    """Mean of the previous, the current and the next row; null at both ends.

    ``series`` is a short series such as :func:`summary.monthly_trends`.
    """
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-1, 1)
    mean = F.when(F.count(value).over(frame) == 3, F.avg(value).over(frame))
    return series.withColumn(name, round_half_up(mean, 6))


def forecast_history(
    cleaned: DataFrame, states: Sequence[str] | None = None, days_back: int = 180
) -> DataFrame:
    """The last ``days_back`` days on record of every state, with the daily index."""

    def floored(c: str) -> Column:
        return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))

    days = (
        in_states(cleaned, states)
        .groupBy("state_name", "date_local")
        .agg(
            round_half_up(F.avg(floored("pm25_cleaned")), 2).alias("pm25"),
            round_half_up(F.avg(floored("aqi_cleaned")), 1).alias("aqi"),
            F.count(F.lit(1)).alias("measurements"),
        )
    )
    return last_days(days, days_back)


def last_days(days: DataFrame, days_back: int) -> DataFrame:
    """The last ``days_back`` rows of each state, from one row for a state and day."""
    newest = Window.partitionBy("state_name").orderBy(F.desc("date_local"))
    return (
        days.withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= days_back)
        .drop("_rn")
    )
