"""Group summaries of the cleaned table.

Every summary is one partial aggregation below one shuffle of group-sized
rows, so a state holding a third of all rows costs no more than the others.
"""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelake.functions.quantiles import exact_quantiles
from measurelake.functions.scalar import (
    aqi_band,
    divide,
    percent_of,
    pm25_level,
    round_half_up,
    season,
    weekday_name,
    weekday_number,
    year_month,
)
from measurelake.model import FilterState
from measurelake.operators.anomalies import detect_anomalies
from measurelake.operators.cleanup import share_by
from measurelake.operators.filters import apply_filter


def _pm25() -> Column:
    return F.col("pm25_cleaned")


def _aqi() -> Column:
    return F.col("aqi_cleaned")


def _mean(value: Column, digits: int) -> Column:
    return round_half_up(F.avg(value), digits)


def _zero_floor(value: Column) -> Column:
    """Null and negative concentrations as zero, as the daily figures count them."""
    return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))


def _rows() -> Column:
    return F.count(F.lit(1))


def _sort_few(df: DataFrame, *order: Column | str) -> DataFrame:
    """Order a result with a fixed number of rows (weekdays, seasons, months) in one task.

    ``orderBy`` would first sample it to partition it by range.  An exchange, since
    ``coalesce`` would merge all partial aggregates in the one task.
    """
    return df.repartition(1).sortWithinPartitions(*order)


def _unhealthy() -> Column:
    return F.count_if(_aqi() > 100)


def _means() -> list[Column]:
    return [
        _rows().alias("measurements"),
        _mean(_pm25(), 2).alias("avg_pm25"),
        _mean(_aqi(), 1).alias("avg_aqi"),
        _unhealthy().alias("unhealthy_days"),
    ]


# -- overview ----------------------------------------------------------------


def kpi_metrics(cleaned: DataFrame, aqi_max: int = 500) -> DataFrame:
    """Headline figures of the whole table, one row.

    ``extreme_aqi_capped`` counts originals above the maximum, and
    ``cleaned_records`` rows some rule has changed.
    """
    row = cleaned.agg(
        _rows().alias("total_rows"),
        F.countDistinct("state_name").alias("unique_states"),
        _mean(_pm25(), 2).alias("avg_pm25"),
        round_half_up(F.stddev_samp(_pm25()), 2).alias("std_pm25"),
        _mean(_aqi(), 1).alias("avg_aqi"),
        F.count_if(F.col("pm25_original") < 0).alias("negative_fixed"),
        F.count_if(F.col("aqi_original").isNull()).alias("null_aqi_fixed"),
        F.count_if(F.col("aqi_original") > aqi_max).alias("extreme_aqi_capped"),
        F.min("date_local").alias("date_start"),
        F.max("date_local").alias("date_end"),
        F.count_if(F.col("cleanup_action") != "UNCHANGED").alias("cleaned_records"),
    )
    median = exact_quantiles(cleaned, [], "pm25_cleaned", {"median_pm25": 0.5})
    median = median.select(round_half_up(F.col("median_pm25"), 2).alias("median_pm25"))
    return row.crossJoin(F.broadcast(median))


MONTH_SCORE = 2.5  # z-score from which a month is anomalous


def monthly_trends(
    cleaned: DataFrame,
    selection: FilterState = FilterState(),
    by_state: bool | None = None,
    quartiles: bool = True,
) -> DataFrame:
    """Monthly means, exact quartiles, spread and unhealthy readings.

    Grouped by state too in comparison mode (or with ``by_state``).  Quartiles
    need a second scan; leave them out where only the means are used.  With
    ``show_anomalies`` months (of each state) have the z-score flags of their means.
    """
    by_state = selection.comparison_mode if by_state is None else by_state
    # Grouped by the first of the month, a number, and labelled when few rows are left.
    first = F.trunc("date_local", "month").alias("month")
    states = ["state_name"] if by_state else []
    keys = ["month", *states]
    rows = apply_filter(cleaned, selection).select(first, *states, "pm25_cleaned", "aqi_cleaned")
    label = year_month(F.col("month")).alias("month")
    base = rows.groupBy(*keys).agg(
        _mean(_pm25(), 2).alias("avg_pm25"),
        _mean(_aqi(), 1).alias("avg_aqi"),
        _unhealthy().alias("unhealthy_days"),
        _rows().alias("measurements"),
        round_half_up(F.stddev_samp(_pm25()), 2).alias("std_pm25"),
    )
    order = [F.asc_nulls_last(k) for k in keys]

    def ordered(df: DataFrame) -> DataFrame:
        if selection.show_anomalies:
            df = detect_anomalies(df, "avg_pm25", "zscore", MONTH_SCORE, states)
        return df.orderBy(*order) if by_state else _sort_few(df, *order)

    if not quartiles:
        return ordered(
            base.select(
                label, *states, "avg_pm25", "avg_aqi", "unhealthy_days", "measurements", "std_pm25"
            )
        )
    quarters = exact_quantiles(
        rows,
        keys,
        "pm25_cleaned",
        {"q1_pm25": 0.25, "median_pm25": 0.5, "q3_pm25": 0.75},
        few_groups=True,  # months, or months of states
    )
    quarters = quarters.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[round_half_up(F.col(q), 2).alias(q) for q in ("q1_pm25", "median_pm25", "q3_pm25")],
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return ordered(
        base.join(quarters, same, "left").select(
            label, *states, "avg_pm25", "q1_pm25", "median_pm25", "q3_pm25", "avg_aqi",
            "unhealthy_days", "measurements", "std_pm25",
        )
    )


def state_comparison(cleaned: DataFrame, selection: FilterState = FilterState()) -> DataFrame:
    """Per state: counties, readings, concentrations, index, and day classes."""
    good = F.count_if(_aqi() <= 50)
    return (
        apply_filter(cleaned, selection)
        .groupBy("state_name")
        .agg(
            F.countDistinct("county_name").alias("counties"),
            _rows().alias("measurements"),
            _mean(_pm25(), 2).alias("avg_pm25"),
            round_half_up(F.max(_pm25()), 2).alias("max_pm25"),
            round_half_up(F.min(_pm25()), 2).alias("min_pm25"),
            _mean(_aqi(), 1).alias("avg_aqi"),
            good.alias("good_days"),
            F.count_if((_aqi() > 50) & (_aqi() <= 100)).alias("moderate_days"),
            _unhealthy().alias("unhealthy_days"),
            percent_of(good, _rows(), 1).alias("pct_good_days"),
        )
        .orderBy(F.desc_nulls_last("avg_pm25"), F.asc_nulls_last("state_name"))
    )


def best_worst_states(compared: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` states with the lowest and the highest mean concentration.

    Takes the result of :func:`state_comparison`; the two ranks are windows over
    that result, one row per state, so the source is read once.
    """
    ranked = compared.where(F.col("avg_pm25").isNotNull()).select(
        "state_name", "avg_pm25", "pct_good_days", "unhealthy_days",
        F.row_number().over(Window.orderBy(F.asc("avg_pm25"), "state_name")).alias("_best"),
        F.row_number().over(Window.orderBy(F.desc("avg_pm25"), "state_name")).alias("_worst"),
    )
    picks = F.array_compact(
        F.array(
            *[
                F.when(F.col(r) <= n, F.struct(F.lit(name).alias("side"),
                                               F.col(r).cast("bigint").alias("place")))
                for name, r in (("best", "_best"), ("worst", "_worst"))
            ]
        )
    )
    return ranked.select(
        F.inline(picks), "state_name", "avg_pm25", "pct_good_days", "unhealthy_days"
    ).orderBy("side", "place")


def state_heatmap(compared: DataFrame, n: int | None = 10) -> DataFrame:
    """Three measures of the ``n`` worst states, each scaled to 0..1 over them.

    Takes the result of :func:`state_comparison`.  A measure with one value only
    has no scale and comes out null.
    """
    measures = ["avg_pm25", "avg_aqi", "pct_good_days"]
    order = [F.desc_nulls_last("avg_pm25"), F.asc_nulls_last("state_name")]
    top = compared.select("state_name", *measures)
    if n is not None:
        top = top.orderBy(*order).limit(n)
    over = Window.partitionBy()

    def scaled(m: str) -> Column:
        low, high = F.min(m).over(over), F.max(m).over(over)
        return round_half_up(divide(F.col(m) - low, high - low), 6)

    return top.select("state_name", *[scaled(m).alias(f"{m}_scaled") for m in measures])


def aqi_distribution(
    cleaned: DataFrame,
    selection: FilterState = FilterState(),
    source: str = "cleaned",
    null_label: str | None = None,
    percent: bool = False,
) -> DataFrame:
    """Rows per index band, optionally with percent.

    ``source="original"`` bands the non-null original index instead.
    """
    rows = apply_filter(cleaned, selection)
    if source == "original":
        rows = rows.where(F.col("aqi_original").isNotNull())
    elif source != "cleaned":
        raise ValueError(f"unknown source: {source!r}")
    rows = rows.select(aqi_band(F.col(f"aqi_{source}"), null_label).alias("category"))
    out = share_by(rows, "category")
    return (out if percent else out.drop("percent")).orderBy("category")


def pm25_levels(cleaned: DataFrame, selection: FilterState = FilterState()) -> DataFrame:
    """Rows per concentration level."""
    rows = apply_filter(cleaned, selection).select(pm25_level(_pm25()).alias("level"))
    return share_by(rows, "level").orderBy(F.asc_nulls_last("level"))


def current_aqi(monthly: DataFrame) -> DataFrame:
    """Mean index of the last month, per state where the input has states.

    Takes the result of :func:`monthly_trends`.
    """
    keys = [c for c in ("state_name",) if c in monthly.columns]
    latest = monthly.groupBy(*keys).agg(
        F.max("month").alias("month"), F.max_by("avg_aqi", "month").alias("current_aqi")
    )
    return latest.withColumn("category", aqi_band(F.col("current_aqi")))


def describe_columns(series: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of numeric columns, one row each.

    ``series`` is a short result such as :func:`monthly_trends`, bounded by the
    calendar; its values fit one aggregate.  For tables of any size see
    :func:`measurelake.functions.quantiles.exact_quantiles`.
    """

    def figures(c: str) -> Column:
        value = F.col(c).cast("double")
        quarters = F.percentile(value, [0.25, 0.5, 0.75])
        return F.struct(
            F.lit(c).alias("metric"),
            F.count(value).alias("count"),
            round_half_up(F.avg(value), 6).alias("mean"),
            round_half_up(F.stddev_samp(value), 6).alias("std"),
            F.min(value).alias("min"),
            *[round_half_up(quarters[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))],
            F.max(value).alias("max"),
        ).alias(c)

    row = series.agg(*[figures(c) for c in columns])
    return row.select(F.inline(F.array(*[F.col(c) for c in columns])))


def trend_summary(monthly: DataFrame) -> DataFrame:
    """Descriptive statistics of the numeric columns of :func:`monthly_trends`."""
    return describe_columns(monthly, [c for c in monthly.columns if c not in ("month", "state_name")])


# -- quarters, weekdays, seasons ---------------------------------------------


def quarterly_trend(cleaned: DataFrame, stable_within: float = 1.0) -> DataFrame:
    """First against fourth quarter per state, with rank and category.

    States without readings in either quarter are left out.  Only the two
    quarters are aggregated, and per state they fold into one row.
    """
    quarters = (
        cleaned.withColumn("quartal", F.quarter("date_local"))
        .where(F.col("quartal").isin(1, 4))
        .groupBy("state_name", "quartal")
        .agg(_mean(_zero_floor(_pm25()), 2).alias("avg_pm25"))
    )

    return trend_of_quarters(quarters, stable_within)


def trend_of_quarters(quarters: DataFrame, stable_within: float = 1.0) -> DataFrame:
    """The trend from (state_name, quartal, avg_pm25) of the two quarters."""

    def of(q: int) -> Column:
        return F.max(F.when(F.col("quartal") == q, F.col("avg_pm25")))

    q1, q4 = F.col("q1_avg"), F.col("q4_avg")
    both = (
        quarters.groupBy("state_name")
        .agg(of(1).alias("q1_avg"), of(4).alias("q4_avg"))
        .where(q1.isNotNull() & q4.isNotNull())
    )
    # The window runs over one row per state.
    rank = F.rank().over(Window.orderBy((q4 - q1).asc())).cast("bigint")
    return both.select(
        "state_name",
        "q1_avg",
        "q4_avg",
        round_half_up(q4 - q1, 2).alias("diff"),
        round_half_up(divide(q4 - q1, q1) * 100.0, 1).alias("prozent_change"),
        rank.alias("improvement_rank"),
        F.when(q4 < q1 - stable_within, "Verbessert")
        .when(q4 > q1 + stable_within, "Verschlechtert")
        .otherwise("Stabil")
        .alias("kategorie"),
    ).orderBy("diff", F.asc_nulls_last("state_name"))


def quarterly_summary(trend: DataFrame) -> DataFrame:
    """States per category of :func:`quarterly_trend`."""
    return _sort_few(trend.groupBy("kategorie").agg(_rows().alias("states")), "kategorie")


def top_changes(trend: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` strongest improvements and worsenings of :func:`quarterly_trend`."""
    per_category = Window.partitionBy("kategorie")
    up = F.row_number().over(per_category.orderBy(F.asc("diff"), F.asc_nulls_last("state_name")))
    down = F.row_number().over(per_category.orderBy(F.desc("diff"), F.asc_nulls_last("state_name")))
    place = F.when(F.col("kategorie") == "Verbessert", up).otherwise(down)
    return (
        trend.where(F.col("kategorie") != "Stabil")
        .withColumn("place", place.cast("bigint"))
        .where(F.col("place") <= n)
        .select("kategorie", "place", "state_name", "diff", "prozent_change")
        .orderBy("kategorie", "place")
    )


def weekday_analysis(cleaned: DataFrame) -> DataFrame:
    """Readings, means and spread per weekday; Sunday is day 0."""
    grouped = cleaned.groupBy(weekday_number(F.col("date_local")).alias("day_num")).agg(
        _rows().alias("messungen"),
        _mean(_pm25(), 2).alias("avg_pm25"),
        _mean(_aqi(), 1).alias("avg_aqi"),
        round_half_up(F.stddev_samp(_pm25()), 2).alias("std_pm25"),
    )
    named = grouped.select(
        "day_num", weekday_name(F.col("day_num")).alias("wochentag"),
        "messungen", "avg_pm25", "avg_aqi", "std_pm25",
    )
    return _sort_few(named, "day_num")


def weekend_vs_weekday(cleaned: DataFrame) -> DataFrame:
    weekend = F.dayofweek("date_local").isin(1, 7)
    day_type = F.when(weekend, "Weekend").otherwise("Weekday").alias("day_type")
    return _sort_few(cleaned.groupBy(day_type).agg(*_means()), "day_type")


def seasonal_pattern(cleaned: DataFrame) -> DataFrame:
    """Means and unhealthy readings per season."""
    seasons = cleaned.groupBy(season(F.col("date_local")).alias("season")).agg(*_means())
    return _sort_few(seasons, F.asc_nulls_last("season"))


# -- sites and places --------------------------------------------------------

_SITE = ["site_name", "state_name", "county_name"]


def site_analysis(
    cleaned: DataFrame, selection: FilterState = FilterState(), limit: int | None = 20
) -> DataFrame:
    """Position, readings and means per site, highest mean concentration first.

    Readings without a site name form a group per county.
    """
    sites = (
        apply_filter(cleaned, selection)
        .groupBy(*_SITE)
        .agg(
            _mean(F.col("latitude"), 4).alias("latitude"),
            _mean(F.col("longitude"), 4).alias("longitude"),
            _rows().alias("measurements"),
            _mean(_pm25(), 2).alias("avg_pm25"),
            _mean(_aqi(), 1).alias("avg_aqi"),
            _mean(F.col("observation_percent"), 1).alias("avg_observation_pct"),
        )
    )
    return top_sites(sites, limit)


def top_sites(sites: DataFrame, limit: int | None) -> DataFrame:
    """The ``limit`` sites with the highest mean concentration, or all."""
    if limit is None:
        return sites
    return sites.orderBy(
        F.desc_nulls_last("avg_pm25"), *[F.asc_nulls_last(c) for c in _SITE]
    ).limit(limit)


def site_hotspots(cleaned: DataFrame, limit: int = 5) -> DataFrame:
    """Named sites with the most unhealthy readings."""
    return (
        cleaned.where(F.col("site_name").isNotNull())
        .groupBy(*_SITE)
        .agg(_unhealthy().alias("unhealthy_days"), _rows().alias("measurements"),
             _mean(_aqi(), 1).alias("avg_aqi"))
        .orderBy(F.desc("unhealthy_days"), *[F.asc_nulls_last(c) for c in _SITE])
        .limit(limit)
    )


def worst_states(cleaned: DataFrame, limit: int = 10) -> DataFrame:
    """States with the highest mean concentration."""
    return (
        cleaned.groupBy("state_name")
        .agg(
            _rows().alias("measurements"),
            _mean(_pm25(), 2).alias("avg_pm25"),
            round_half_up(F.max(_pm25()), 2).alias("max_pm25"),
            _mean(_aqi(), 1).alias("avg_aqi"),
            _unhealthy().alias("unhealthy_days"),
        )
        .orderBy(F.desc_nulls_last("avg_pm25"), F.asc_nulls_last("state_name"))
        .limit(limit)
    )


def event_deep_dive(
    cleaned: DataFrame, state: str, first: date, last: date, aqi_above: float = 150,
    limit: int = 20,
) -> DataFrame:
    """Worst readings of one state within a period, with their index band.

    The period is a date range and not a text prefix, so it reaches the files.
    """
    shown = ["county_name", "date_local", "pm25_cleaned", "aqi_cleaned", "aqi_category"]
    return (
        apply_filter(
            cleaned, FilterState((state,), first, last), [F.col("aqi_cleaned") > aqi_above]
        )
        .withColumn("aqi_category", aqi_band(_aqi()))
        .select(*shown)
        .orderBy(F.desc("aqi_cleaned"), *[F.asc_nulls_last(c) for c in shown])
        .limit(limit)
    )


def worst_national_day(cleaned: DataFrame, limit: int = 1) -> DataFrame:
    """Days with the highest mean concentration over all states."""
    return (
        cleaned.groupBy("date_local")
        .agg(_mean(_pm25(), 2).alias("avg_pm25"), _mean(_aqi(), 1).alias("avg_aqi"),
             _rows().alias("measurements"))
        .orderBy(F.desc_nulls_last("avg_pm25"), "date_local")
        .limit(limit)
    )
