"""A stored daily rollup, and the repeated questions answered from it.

One row for each state, county, site and day holds sums, counts, minima and maxima,
which add up to any coarser group.  Questions about states, quarters, weekdays, sites
and the forecast history are answered from it without reading the readings again.
The rollup is a table of its own that outlives the session, in month folders: a rerun
of one month replaces that month (see :mod:`measurelake.plans.incremental`).

The rows of a group are reduced before they are grouped, so a state with a third of
all readings is many rows of many days here, and partial sums of them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measurelake.functions.scalar import divide, percent_of, round_half_up, weekday_name, weekday_number
from measurelake.model import FilterState
from measurelake.operators import series, summary
from measurelake.operators.filters import apply_filter, in_states
from measurelake.sources import writers

KEYS = ("state_name", "county_name", "site_name", "date_local")

_MEASURES = {"pm25": "pm25_cleaned", "aqi": "aqi_cleaned", "latitude": "latitude",
             "longitude": "longitude", "observed": "observation_percent"}
_FLOORED = ("pm25", "aqi")  # also summed with missing and negative values as zero
_SHARES = 8  # tasks that the readings of one key are dealt to


def daily_rollup(cleaned: DataFrame) -> DataFrame:
    """One row for each state, county, site and day; null is a value of a key like any other.

    ``n`` counts readings, ``n_<m>`` those with a value of a measure and ``sum_<m>`` adds them
    up.  ``m2_pm25`` is the sum of squared deviations from the row's own mean, from which
    deviations of larger groups follow without losing digits.

    Readings are dealt by key before they are grouped: most keys have few readings, so what
    is grouped within a task of the scan would grow with the rows of a compressed file.
    Those of one key go to several tasks, so a frequent one is reduced before it meets.
    The number of tasks is told, as adaptive execution would merge them by compressed size.
    """
    pm25, aqi = F.col("pm25_cleaned"), F.col("aqi_cleaned")
    measures = list(_MEASURES.values())
    share = F.pmod(F.xxhash64(*measures), F.lit(_SHARES))
    tasks = int(cleaned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cleaned.select(*KEYS, *measures).repartition(tasks, *KEYS, share)
    figures = [F.count(F.lit(1)).alias("n")]
    for name, column in _MEASURES.items():
        figures += [F.sum(column).alias(f"sum_{name}"), F.count(column).alias(f"n_{name}")]
        if name in _FLOORED:
            floored = F.greatest(F.coalesce(column, F.lit(0.0)), F.lit(0.0))
            figures.append(F.sum(floored).alias(f"floored_{name}"))
    return dealt.groupBy(*KEYS).agg(
        *figures,
        F.min(pm25).alias("min_pm25"), F.max(pm25).alias("max_pm25"),
        (F.var_pop(pm25) * F.count(pm25)).alias("m2_pm25"),
        F.count_if(aqi <= 50).alias("n_good"),
        F.count_if((aqi > 50) & (aqi <= 100)).alias("n_moderate"),
        F.count_if(aqi > 100).alias("n_unhealthy"),
    )


def write_rollup(rollup: DataFrame, path: str) -> str:
    """Write a rollup in month folders; of an existing one the months at hand are replaced."""
    return writers.write_months(rollup, path, "date_local")


def read_rollup(spark: SparkSession, path: str, keep_folders: bool = False) -> DataFrame:
    """A stored rollup; with ``keep_folders`` :func:`apply_filter` prunes months by them."""
    found = spark.read.parquet(path)
    return found if keep_folders else found.drop("year", "month")


def _total(name: str) -> Column:
    return F.sum(name)


def _mean(measure: str, digits: int) -> Column:
    return round_half_up(divide(_total(f"sum_{measure}"), _total(f"n_{measure}")), digits)


def _readings() -> Column:
    return F.coalesce(_total("n"), F.lit(0))


def merged(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """The rollup with fewer keys: rows add up, and can be added up again."""
    sums = [c for c in rollup.columns if c.startswith(("sum_", "n_", "floored_")) or c == "n"]
    total = rollup.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], F.min("min_pm25").alias("min_pm25"),
        F.max("max_pm25").alias("max_pm25"), F.sum("m2_pm25").alias("_within"))
    # Deviations within rows, and of rows' means from the group's.
    centre = total.select(*[F.col(k).alias(f"_of_{k}") for k in keys],
                          divide(F.col("sum_pm25"), F.col("n_pm25")).alias("_centre"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    off = divide(F.col("sum_pm25"), F.col("n_pm25")) - F.col("_centre")
    between = (rollup.join(centre, reduce(and_, same)) if keys else rollup.crossJoin(centre)).groupBy(*keys).agg(
        F.sum(off * off * F.col("n_pm25")).alias("_between"))
    named = between.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_between")
    joined = total.join(named, reduce(and_, same), "left") if keys else total.crossJoin(named)
    return joined.withColumn("m2_pm25", F.col("_within") + F.coalesce("_between", F.lit(0.0))).select(
        *keys, *sums, "min_pm25", "max_pm25", "m2_pm25")


def state_comparison(rollup: DataFrame, selection: FilterState = FilterState()) -> DataFrame:
    """:func:`measurelake.operators.summary.state_comparison` from the rollup."""
    good, n = F.coalesce(_total("n_good"), F.lit(0)), _readings()
    return (
        apply_filter(rollup, selection).groupBy("state_name").agg(
            F.countDistinct("county_name").alias("counties"),
            n.alias("measurements"),
            _mean("pm25", 2).alias("avg_pm25"),
            round_half_up(F.max("max_pm25"), 2).alias("max_pm25"),
            round_half_up(F.min("min_pm25"), 2).alias("min_pm25"),
            _mean("aqi", 1).alias("avg_aqi"),
            good.alias("good_days"),
            _total("n_moderate").alias("moderate_days"),
            _total("n_unhealthy").alias("unhealthy_days"),
            percent_of(good, n, 1).alias("pct_good_days"),
        ).orderBy(F.desc_nulls_last("avg_pm25"), F.asc_nulls_last("state_name"))
    )


def quarterly_trend(rollup: DataFrame, stable_within: float = 1.0) -> DataFrame:
    """:func:`measurelake.operators.summary.quarterly_trend` from the rollup."""
    quarters = (
        rollup.withColumn("quartal", F.quarter("date_local")).where(F.col("quartal").isin(1, 4))
        .groupBy("state_name", "quartal")
        .agg(round_half_up(divide(_total("floored_pm25"), _total("n")), 2).alias("avg_pm25"))
    )
    return summary.trend_of_quarters(quarters, stable_within)


def weekday_analysis(rollup: DataFrame) -> DataFrame:
    """:func:`measurelake.operators.summary.weekday_analysis` from the rollup."""
    days = merged(rollup.withColumn("day_num", weekday_number(F.col("date_local"))), ["day_num"])
    mean = {m: divide(F.col(f"sum_{m}"), F.col(f"n_{m}")) for m in ("pm25", "aqi")}
    spread = F.sqrt(divide(F.col("m2_pm25"), F.col("n_pm25") - 1))
    named = days.select(
        "day_num", weekday_name(F.col("day_num")).alias("wochentag"), F.col("n").alias("messungen"),
        round_half_up(mean["pm25"], 2).alias("avg_pm25"), round_half_up(mean["aqi"], 1).alias("avg_aqi"),
        round_half_up(spread, 2).alias("std_pm25"))
    return named.orderBy("day_num")


def site_analysis(
    rollup: DataFrame, selection: FilterState = FilterState(), limit: int | None = 20
) -> DataFrame:
    """:func:`measurelake.operators.summary.site_analysis` from the rollup."""
    sites = apply_filter(rollup, selection).groupBy("site_name", "state_name", "county_name").agg(
        _mean("latitude", 4).alias("latitude"), _mean("longitude", 4).alias("longitude"),
        _readings().alias("measurements"), _mean("pm25", 2).alias("avg_pm25"), _mean("aqi", 1).alias("avg_aqi"),
        _mean("observed", 1).alias("avg_observation_pct"))
    return summary.top_sites(sites, limit)


def forecast_history(rollup: DataFrame, states=None, days_back: int = 180) -> DataFrame:
    """:func:`measurelake.operators.series.forecast_history` from the rollup."""
    days = in_states(rollup, states).groupBy("state_name", "date_local").agg(
        round_half_up(divide(_total("floored_pm25"), _total("n")), 2).alias("pm25"),
        round_half_up(divide(_total("floored_aqi"), _total("n")), 1).alias("aqi"),
        _readings().alias("measurements"))
    return series.last_days(days, days_back)


def monthly_means(rollup: DataFrame, selection: FilterState = FilterState(), by_state: bool = False) -> DataFrame:
    """The means and spread of :func:`measurelake.operators.summary.monthly_trends`, without quartiles."""
    states = ["state_name"] if by_state else []
    rows = apply_filter(rollup, selection).withColumn("month", F.trunc("date_local", "month"))
    months = merged(rows, ["month", *states])
    return months.select(
        F.date_format("month", "yyyy-MM").alias("month"), *states,
        round_half_up(divide(F.col("sum_pm25"), F.col("n_pm25")), 2).alias("avg_pm25"),
        round_half_up(divide(F.col("sum_aqi"), F.col("n_aqi")), 1).alias("avg_aqi"),
        F.col("n_unhealthy").alias("unhealthy_days"), F.col("n").alias("measurements"),
        round_half_up(F.sqrt(divide(F.col("m2_pm25"), F.col("n_pm25") - 1)), 2).alias("std_pm25"),
    ).orderBy(F.asc_nulls_last("month"), *[F.asc_nulls_last(s) for s in states])
