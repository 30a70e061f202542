"""Data-quality audit, validation and problem samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelake.functions.quantiles import SKETCH, bracketed_quantiles, exact_quantiles
from measurelake.functions.scalar import (
    aqi_from_pm25,
    divide,
    number_draw,
    number_range,
    percent_of,
    round_half_up,
    text_draw,
    text_range,
)
from measurelake.model import CleanupConfig
from measurelake.operators.cleanup import quality_flag

# Names of the audit counts before cleanup.
COUNTS_BEFORE = [
    "null_state",
    "null_pm25",
    "null_aqi",
    "null_standard",
    "null_site",
    "negative_pm25",
    "extreme_pm25",
    "negative_aqi",
    "extreme_aqi",
    "unreliable_obs",
    "low_quality_obs",
    "acceptable_obs",
    "high_quality_obs",
]
COUNTS_AFTER = ["null_pm25", "null_aqi", "negative_pm25", "negative_aqi", "extreme_aqi"]

# Field order of the two audits.
AUDIT_BEFORE = [
    "total_rows",
    *COUNTS_BEFORE,
    "avg_pm25",
    "median_pm25",
    "min_pm25",
    "max_pm25",
    "avg_aqi",
    "median_aqi",
    "min_aqi",
    "max_aqi",
    "earliest_date",
    "latest_date",
    "unique_states",
    "unique_counties",
]
AUDIT_AFTER = [
    "total_rows",
    *COUNTS_AFTER,
    "avg_pm25",
    "median_pm25",
    "min_pm25",
    "max_pm25",
    "avg_aqi",
    "median_aqi",
    "min_aqi",
    "max_aqi",
]


def _between(value: Column, low: float, high: float) -> Column:
    return (value >= low) & (value < high)


def _tests(pm25: str, aqi: str, config: CleanupConfig) -> dict[str, Column]:
    p, a = F.col(pm25), F.col(aqi)
    return {
        "null_pm25": p.isNull(),
        "null_aqi": a.isNull(),
        "negative_pm25": p < 0,
        "negative_aqi": a < 0,
        "extreme_aqi": a > config.aqi_max,
    }


def _tests_before(pm25: str, aqi: str, config: CleanupConfig) -> dict[str, Column]:
    seen = F.col("observation_percent")
    low, mid, high = (
        config.unreliable_below,
        config.observation_percent_min,
        config.high_quality_from,
    )
    return {
        **_tests(pm25, aqi, config),
        "null_state": F.col("state_name").isNull(),
        "null_standard": F.col("pollutant_standard").isNull(),
        "null_site": F.col("site_name").isNull(),
        "extreme_pm25": F.col(pm25) > config.pm25_extreme_threshold,
        "unreliable_obs": seen < low,
        "low_quality_obs": _between(seen, low, mid),
        "acceptable_obs": _between(seen, mid, high),
        "high_quality_obs": seen >= high,
    }


_PLACES = ("state_name", "county_name")
_ACCURACY = 10_000  # of approximate medians: the rank is off by a ten-thousandth at most

Sides = dict[str, tuple[str, str, dict[str, Column]]]


def _figures(sides: Sides, before: bool) -> tuple[list[Column], list[Column]]:
    """Additive figures of every side, and what sums them up to one row."""
    partial: list[Column] = [F.count(F.lit(1)).alias("total_rows")]
    final: list[Column] = [F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows")]
    for side, (pm25, aqi, tests) in sides.items():
        for name, test in tests.items():
            partial.append(F.count_if(test).alias(f"{side}{name}"))
            final.append(F.coalesce(F.sum(f"{side}{name}"), F.lit(0)).alias(f"{side}{name}"))
        for metric, column in (("pm25", pm25), ("aqi", aqi)):
            key = f"{side}{metric}"
            value = F.col(column)
            partial += [
                F.sum(value).alias(f"_sum_{key}"),
                F.count(value).alias(f"_n_{key}"),
                F.min(value).alias(f"_min_{key}"),
                F.max(value).alias(f"_max_{key}"),
            ]
            mean = divide(F.sum(f"_sum_{key}"), F.sum(f"_n_{key}"))
            final.append(round_half_up(mean, 2).alias(f"{side}avg_{metric}"))
            for bound, pick in (("min", F.min), ("max", F.max)):
                found = pick(f"_{bound}_{key}")
                if metric == "pm25":
                    found = round_half_up(found, 2)
                final.append(found.alias(f"{side}{bound}_{metric}"))
    if before:
        partial += [F.min("date_local").alias("_first"), F.max("date_local").alias("_last")]
        final += [F.min("_first").alias("earliest_date"), F.max("_last").alias("latest_date")]
    return partial, final


def _distinct() -> list[Column]:
    """Distinct places, from rows of one partial per place."""
    return [
        F.countDistinct("state_name").alias("unique_states"),
        F.countDistinct("county_name").alias("unique_counties"),
    ]


def _audit(df: DataFrame, sides: Sides, before: bool = False, places: bool = False) -> DataFrame:
    """One row of audit figures for every side, in one scan.

    With ``places`` rows are first reduced to one partial per (state, county),
    where both distinct counts can be read off; counting two distinct columns
    directly would instead triple every row before the shuffle.
    """
    partial, final = _figures(sides, before)
    if places:
        return df.groupBy(*_PLACES).agg(*partial).agg(*final, *_distinct())
    return df.agg(*partial).agg(*final)


def _medians(df: DataFrame, named: dict[str, str]) -> DataFrame:
    """One row with the median of each column, exact, in one scan for all of them.

    Each column's values are counted by themselves within the scan's tasks, so that
    unrelated or unrounded columns do not multiply.
    """
    values = F.array(*[F.col(c).cast("double") for c in named.values()])
    long = df.select(F.posexplode(values).alias("metric", "value"))
    found = exact_quantiles(long, ["metric"], "value", {"median": 0.5}, few_groups=True)
    return _median_row(found, named)


def _median_row(found: DataFrame, named: dict[str, str]) -> DataFrame:
    return found.agg(
        *[
            round_half_up(F.max(F.when(F.col("metric") == i, F.col("median"))), 2).alias(n)
            for i, n in enumerate(named)
        ]
    )


def _with_medians(row: DataFrame, medians: DataFrame) -> DataFrame:
    # Both sides are global aggregates, so each is exactly one row.
    return row.crossJoin(F.broadcast(medians))


def _approximate(df: DataFrame, sides: Sides, before: bool, named: dict[str, str]) -> DataFrame:
    """Audit with approximate medians and distinct counts: one scan, one aggregate, no shuffle by place."""
    partial, final = _figures(sides, before)
    for name, column in named.items():
        partial.append(F.percentile_approx(F.col(column).cast("double"), 0.5, _ACCURACY).alias(name))
        final.append(round_half_up(F.max(name), 2).alias(name))
    if before:
        for name, column in zip(("unique_states", "unique_counties"), _PLACES, strict=True):
            partial.append(F.approx_count_distinct(column, 0.02).alias(name))
            final.append(F.max(name).alias(name))
    return df.agg(*partial).agg(*final)


def _whole_audit(df: DataFrame, sides: Sides, before: bool, named: dict[str, str],
                 approximate: bool) -> DataFrame:
    if approximate:
        return _approximate(df, sides, before, named)
    return _with_medians(_audit(df, sides, before, places=before), _medians(df, named))


def quality_audit(
    raw: DataFrame, config: CleanupConfig = CleanupConfig(), approximate: bool = False
) -> DataFrame:
    """Audit of a raw table: one row, 26 figures.

    Medians and distinct counts are exact in two scans, or ``approximate`` in one:
    a median then is a value of the table whose rank is off by a ten-thousandth at
    most, and a distinct count has a standard error of 2 %.
    """
    sides = {"": ("pm25_raw", "aqi_raw", _tests_before("pm25_raw", "aqi_raw", config))}
    named = {"median_pm25": "pm25_raw", "median_aqi": "aqi_raw"}
    return _whole_audit(raw, sides, True, named, approximate).select(*AUDIT_BEFORE)


def quality_audit_pct(raw: DataFrame, config: CleanupConfig = CleanupConfig()) -> DataFrame:
    """The audit counts with their percent of all rows, one row per count."""
    tests = _tests_before("pm25_raw", "aqi_raw", config)
    row = _audit(raw, {"": ("pm25_raw", "aqi_raw", tests)})
    return _as_rows(row, COUNTS_BEFORE, "metric", "rows").select(
        "metric", "rows", percent_of(F.col("rows"), F.col("total_rows"), 1).alias("percent")
    )


def _as_rows(row: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(n).alias(key), F.col(n).alias(value)) for n in names])
    return row.select("total_rows", F.inline(entries))


def quality_audit_after(
    cleaned: DataFrame, config: CleanupConfig = CleanupConfig(), approximate: bool = False
) -> DataFrame:
    """Audit of the cleaned values: one row, 14 figures; options as for :func:`quality_audit`."""
    sides = {"": ("pm25_cleaned", "aqi_cleaned", _tests("pm25_cleaned", "aqi_cleaned", config))}
    named = {"median_pm25": "pm25_cleaned", "median_aqi": "aqi_cleaned"}
    return _whole_audit(cleaned, sides, False, named, approximate).select(*AUDIT_AFTER)


_BOTH_MEDIANS = {
    "before_median_pm25": "pm25_original",
    "before_median_aqi": "aqi_original",
    "after_median_pm25": "pm25_cleaned",
    "after_median_aqi": "aqi_cleaned",
}


def _both_sides(config: CleanupConfig) -> Sides:
    return {
        "before_": ("pm25_original", "aqi_original",
                    _tests_before("pm25_original", "aqi_original", config)),
        "after_": ("pm25_cleaned", "aqi_cleaned", _tests("pm25_cleaned", "aqi_cleaned", config)),
    }


def audit_both(
    cleaned: DataFrame, config: CleanupConfig = CleanupConfig(), medians: bool = False,
    approximate: bool = False,
) -> DataFrame:
    """Audits before and after cleanup as one row, from one scan of the cleaned table.

    The cleaned table keeps the originals, so columns come as ``before_*`` and
    ``after_*``.  Exact medians cost a second scan and are optional; ``approximate``
    ones come from the same scan.
    """
    if approximate:
        return _approximate(cleaned, _both_sides(config), True, _BOTH_MEDIANS)
    row = _audit(cleaned, _both_sides(config), before=True, places=True)
    return _with_medians(row, both_medians(cleaned)) if medians else row


def both_medians(cleaned: DataFrame) -> DataFrame:
    """The exact medians of :func:`audit_both`, one row."""
    return _medians(cleaned, _BOTH_MEDIANS)


def audit_parts(
    cleaned: DataFrame, config: CleanupConfig = CleanupConfig(), labels: Sequence[str] = (),
    profiled: Sequence[str] = (),
) -> DataFrame:
    """Additive audit figures per place and label, a small table from one scan.

    :func:`audit_of_parts` makes the audit of it.  ``total_rows`` counts the rows, so
    it yields label counts too, and ``_known_*`` the non-null values of ``profiled``
    columns.
    """
    partial, _ = _figures(_both_sides(config), before=True)
    known = [F.count(c).alias(f"_known_{c}") for c in profiled]
    return cleaned.groupBy(*_PLACES, *labels).agg(*partial, *known)


def audit_of_parts(parts: DataFrame, config: CleanupConfig = CleanupConfig()) -> DataFrame:
    """The row of :func:`audit_both`, without medians, from :func:`audit_parts`."""
    _, final = _figures(_both_sides(config), before=True)
    return parts.agg(*final, *_distinct())


_REGISTERS = 12  # power of two of the registers of a distinct count: a standard error of 1.6 %


def audit_states(
    cleaned: DataFrame, config: CleanupConfig = CleanupConfig(), keys: Sequence[str] = ()
) -> DataFrame:
    """Mergeable audit figures per ``keys``: parts of many runs add up to the audit of all.

    Counts, sums and bounds are exact.  Places are counted in HyperLogLog states and
    values kept in KLL states, so that a part's size depends on neither.  Parts are merged by
    :func:`merge_audit_states`, again and again; :func:`audit_of_states` reads them.
    """
    partial, _ = _figures(_both_sides(config), before=True)
    states = [F.hll_sketch_agg(place, _REGISTERS).alias(f"_hll_{place}") for place in _PLACES]
    states += [F.kll_sketch_agg_double(F.col(c).cast("double"), SKETCH).alias(f"_kll_{name}")
               for name, c in _BOTH_MEDIANS.items()]
    return cleaned.groupBy(*keys).agg(*partial, *states)


def merge_audit_states(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Parts of :func:`audit_states` merged to fewer keys, of the same form."""

    def merged(name: str) -> Column:
        if name.startswith("_hll_"):
            return F.hll_union_agg(name)
        if name.startswith("_kll_"):
            return F.kll_merge_agg_double(name, SKETCH)
        if name.startswith("_min_") or name == "_first":
            return F.min(name)
        if name.startswith("_max_") or name == "_last":
            return F.max(name)
        return F.coalesce(F.sum(name), F.lit(0)) if not name.startswith("_sum_") else F.sum(name)

    return states.groupBy(*keys).agg(*[merged(c).alias(c) for c in _state_columns()])


def _state_columns(config: CleanupConfig = CleanupConfig()) -> list[str]:
    names = ["total_rows"]
    for side, (_, _, tests) in _both_sides(config).items():
        names += [f"{side}{t}" for t in tests]
        names += [f"_{f}_{side}{m}" for m in ("pm25", "aqi") for f in ("sum", "n", "min", "max")]
    names += ["_first", "_last", *[f"_hll_{p}" for p in _PLACES]]
    return names + [f"_kll_{name}" for name in _BOTH_MEDIANS]


def audit_of_states(states: DataFrame, config: CleanupConfig = CleanupConfig()) -> DataFrame:
    """The row of :func:`audit_both` with medians, from merged parts.

    Counts, means and bounds are exact.  A median is a value of the table whose rank is off
    by 0.5 % of the rows (with a probability of 99 %), distinct counts have a standard
    error of 1.6 %.  Exact medians: :func:`medians_of_states`.
    """
    _, final = _figures(_both_sides(config), before=True)
    places = [F.hll_sketch_estimate(F.hll_union_agg(f"_hll_{p}")).alias(n)
              for p, n in zip(_PLACES, ("unique_states", "unique_counties"), strict=True)]
    sketches = [F.kll_merge_agg_double(f"_kll_{n}", SKETCH).alias(f"_kll_{n}") for n in _BOTH_MEDIANS]
    known = [F.coalesce(F.sum(f"_n_{_side_metric(n)}"), F.lit(0)).alias(f"_known_{n}") for n in _BOTH_MEDIANS]
    row = states.agg(*final, *places, *sketches, *known)
    medians = [
        F.when(F.col(f"_known_{n}") > 0, round_half_up(
            F.kll_sketch_get_quantile_double(f"_kll_{n}", F.lit(0.5)), 2)).alias(n)
        for n in _BOTH_MEDIANS]
    return row.select("*", *medians).drop(
        *[f"_kll_{n}" for n in _BOTH_MEDIANS], *[f"_known_{n}" for n in _BOTH_MEDIANS])


def _side_metric(median: str) -> str:
    """``before_median_pm25`` -> ``before_pm25``, the name of the sums of the same values."""
    return median.replace("median_", "")


def medians_of_states(states: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The exact medians of :func:`both_medians`, in one scan: the merged states give the brackets."""
    row = merge_audit_states(states)
    metrics = [
        F.struct(F.lit(i).alias("metric"), F.col(f"_kll_{n}").alias("_sketch"),
                 F.col(f"_n_{_side_metric(n)}").alias("_total"),
                 F.col(f"_min_{_side_metric(n)}").cast("double").alias("_min"),
                 F.col(f"_max_{_side_metric(n)}").cast("double").alias("_max"),
                 F.col(f"_n_{_side_metric(n)}").alias("_numbers"))
        for i, n in enumerate(_BOTH_MEDIANS)]
    sketched = row.select(F.inline(F.array(*metrics)))
    values = F.array(*[F.col(c).cast("double") for c in _BOTH_MEDIANS.values()])
    long = cleaned.select(F.posexplode(values).alias("metric", "value"))
    return _median_row(
        bracketed_quantiles(long, ["metric"], "value", {"median": 0.5}, sketched), _BOTH_MEDIANS)


def before_after(cleaned: DataFrame, config: CleanupConfig = CleanupConfig()) -> DataFrame:
    """Two rows, VORHER and NACHHER, comparing raw and cleaned values (one scan)."""
    return before_after_of(_audit(cleaned, _both_sides(config)))


def before_after_of(both: DataFrame) -> DataFrame:
    """The same from the row of :func:`audit_both`."""
    fields = ["null_pm25", "null_aqi", "negative_pm25", "extreme_aqi",
              "avg_pm25", "min_pm25", "max_pm25", "min_aqi", "max_aqi"]

    def side(status: str, prefix: str) -> Column:
        return F.struct(
            F.lit(status).alias("status"),
            F.col("total_rows").alias("total"),
            *[F.col(f"{prefix}{f}").cast(_kind(f)).alias(f) for f in fields],
        )

    return both.select(F.inline(F.array(side("VORHER", "before_"), side("NACHHER", "after_"))))


def _kind(field: str) -> str:
    return "double" if field.startswith(("avg_", "min_", "max_")) else "bigint"


def cleanup_success(cleaned: DataFrame, config: CleanupConfig = CleanupConfig()) -> DataFrame:
    """Problems found, fixed and left, success rate and verdict, one row."""
    return cleanup_success_of(_audit(cleaned, _both_sides(config)))


def cleanup_success_of(both: DataFrame) -> DataFrame:
    """The same from the row of :func:`audit_both`."""

    def total(prefix: str) -> Column:
        return reduce(add, [F.col(f"{prefix}{c}") for c in ("null_aqi", "negative_pm25", "extreme_aqi")])

    counted = both.select(
        total("before_").alias("problems_identified"), total("after_").alias("problems_remaining")
    )
    fixed = F.col("problems_identified") - F.col("problems_remaining")
    rate = F.coalesce(divide(fixed, F.col("problems_identified")) * 100.0, F.lit(100.0))
    return counted.select(
        "problems_identified",
        fixed.alias("problems_fixed"),
        "problems_remaining",
        round_half_up(rate, 1).alias("success_rate"),
        F.when(rate == 100, "PERFEKT")
        .when(rate >= 95, "SEHR GUT")
        .when(rate >= 80, "GUT")
        .otherwise("WARNUNG")
        .alias("verdict"),
    )


# -- problem classes ---------------------------------------------------------

_PLACE = ("state_name", "county_name", "date_local")


def problem_classes(config: CleanupConfig = CleanupConfig()) -> dict[str, tuple[Column, tuple]]:
    """Class name -> (predicate on the raw table, columns worth showing)."""
    pm25, aqi = F.col("pm25_raw"), F.col("aqi_raw")
    return {
        "NULL_AQI": (aqi.isNull(), (*_PLACE, "pm25_raw", "aqi_raw")),
        "NEGATIVE_PM25": (pm25 < 0, (*_PLACE, "pm25_raw", "sample_duration")),
        "EXTREME_AQI": (aqi > config.aqi_max, (*_PLACE, "pm25_raw", "aqi_raw")),
        "EXTREME_PM25": (pm25 > config.pm25_extreme_threshold, (*_PLACE, "pm25_raw", "aqi_raw")),
        "LOW_OBSERVATION": (
            F.col("observation_percent") < config.unreliable_below,
            ("state_name", "date_local", "observation_percent", "pm25_raw", "aqi_raw"),
        ),
    }


def problem_counts(raw: DataFrame, config: CleanupConfig = CleanupConfig()) -> DataFrame:
    """Rows per problem class, one scan for all classes."""
    classes = problem_classes(config)
    row = raw.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(test).alias(name) for name, (test, _) in classes.items()],
    )
    return _as_rows(row, list(classes), "problem", "rows").select("problem", "rows")


def problem_examples(
    raw: DataFrame,
    config: CleanupConfig = CleanupConfig(),
    seed: int = 0,
    portable: bool = False,
) -> DataFrame:
    """Up to ``example_limit`` pseudo-random rows per problem class.

    A row is repeated once per class it falls into and gets a draw, which depends
    on ``seed`` and all its columns, so a retried task draws the same rows and rows
    that only look alike are drawn apart.  The rows with the lowest draws are the
    sample.  A first pass counts draws in 65,536 ranges and yields the range each
    class needs to reach; only the rows up to there are ranked, and none of a large
    class has to be sorted whole.
    ``portable`` draws by MD5 of the shown columns, which other engines can repeat.
    """
    classes = problem_classes(config)
    shown = list(dict.fromkeys(c for _, cols in classes.values() for c in cols))
    number = F.col("_class")
    values = [
        F.when(
            number.isin([i for i, (_, cols) in enumerate(classes.values()) if c in cols]), F.col(c)
        ).alias(c)
        for c in shown
    ]
    tests = [test for test, _ in classes.values()]
    if portable:
        # Doubles enter the draw as whole millionths, which print alike everywhere.
        key = [
            F.floor(F.col(c) * 1e6 + 0.5) if c in ("pm25_raw", "observation_percent") else F.col(c)
            for c in shown
        ]
        draw, part, row = text_draw(F.lit(str(seed)), *key), text_range, F.lit(0)
    else:
        draw, part = number_draw(F.lit(str(seed)), number, F.col("_row")), number_range
        row = F.xxhash64(*[F.col(c) for c in raw.columns])
    drawn = (
        raw.where(reduce(or_, tests))
        .select(*shown, row.alias("_row"), F.posexplode(F.array(*tests)).alias("_class", "_hit"))
        .where("_hit")
        .select(number, "_row", *values)
        .withColumn("_draw", draw)
        .withColumn("_range", part(F.col("_draw")))
    )
    upto = Window.partitionBy("_class").orderBy("_range")
    # At most 65,536 rows per class, and one row per class to broadcast.
    reach = (
        drawn.groupBy("_class", "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_n", F.sum("_n").over(upto))
        .groupBy(number.alias("_k_class"))
        .agg(F.min(F.when(F.col("_n") >= config.example_limit, F.col("_range"))).alias("_last"))
    )
    near = drawn.join(
        F.broadcast(reach),
        (number == F.col("_k_class"))
        & (F.col("_last").isNull() | (F.col("_range") <= F.col("_last"))),
    )
    lowest = Window.partitionBy("_class").orderBy("_draw", *shown)
    return (
        near.withColumn("_rank", F.row_number().over(lowest))
        .where(F.col("_rank") <= config.example_limit)
        .select(F.array(*[F.lit(n) for n in classes])[number].alias("problem"), *shown)
    )


# -- quality of the cleaned table --------------------------------------------


def data_quality_metrics(cleaned: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Nulls, fixed negatives, outliers beyond ``sigmas`` deviations, and the score."""
    # Value counts instead of rows from here on: the table is read once, and mean,
    # deviation and outliers all come from the same shuffle.
    counts = cleaned.groupBy(
        F.col("pm25_cleaned").alias("_v"),
        F.coalesce(F.col("pm25_original") < 0, F.lit(False)).alias("_negative"),
    ).agg(F.count(F.lit(1)).alias("_n"))
    v, n = F.col("_v"), F.col("_n")
    # One row each: the mean, then the deviation around it.
    mean = counts.agg(
        divide(F.sum(v * n), F.sum(F.when(v.isNotNull(), n))).alias("_mean"),
        F.sum(F.when(v.isNotNull(), n)).alias("_known"),
    )
    off = v - F.col("_mean")
    spread = counts.crossJoin(F.broadcast(mean)).agg(
        F.max("_mean").alias("_mean"),
        F.sqrt(divide(F.sum(off * off * n), F.max("_known") - 1)).alias("_std"),
    )

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    counted = counts.crossJoin(F.broadcast(spread)).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_records"),
        rows(v.isNull()).alias("null_count"),
        rows(F.col("_negative")).alias("negative_count"),
        rows(F.abs(off) > F.lit(float(sigmas)) * F.col("_std")).alias("outlier_count"),
    )
    total = F.col("total_records")

    def lost(column: str, weight: float) -> Column:
        return F.coalesce(divide(F.col(column), total), F.lit(0.0)) * weight

    score = F.greatest(
        F.lit(100.0)
        - (lost("null_count", 20.0) + lost("negative_count", 20.0) + lost("outlier_count", 10.0)),
        F.lit(0.0),
    )
    complete = F.coalesce((F.lit(1.0) - divide(F.col("null_count"), total)) * 100.0, F.lit(0.0))
    return counted.select(
        "total_records",
        "null_count",
        "negative_count",
        "outlier_count",
        round_half_up(complete, 6).alias("completeness_score"),
        round_half_up(F.when(total == 0, F.lit(0.0)).otherwise(score), 6).alias("quality_score"),
    )


# -- report ------------------------------------------------------------------


def cleanup_report(cleaned: DataFrame, config: CleanupConfig = CleanupConfig()) -> DataFrame:
    """Settings and both audits as (section, key, value) rows of text."""
    return cleanup_report_of(audit_both(cleaned, config, medians=True), config)


def cleanup_report_of(row: DataFrame, config: CleanupConfig = CleanupConfig()) -> DataFrame:
    """The same from the row of :func:`audit_both` with medians."""
    sides = {f.removeprefix("before_"): f for f in row.columns if f.startswith("before_")}

    def entry(section: str, key: str, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(key).alias("key"),
            value.cast("string").alias("value"),
        )

    entries = [entry("CONFIGURATION", k, F.lit(str(v))) for k, v in asdict(config).items()]
    entries += [entry("STATISTICS BEFORE", n, F.col(sides.get(n, n))) for n in AUDIT_BEFORE]
    entries += [
        entry("STATISTICS AFTER", n, F.col(n if n == "total_rows" else f"after_{n}"))
        for n in AUDIT_AFTER
    ]
    return row.select(F.inline(F.array(*entries)))


# -- quality queries over the raw table --------------------------------------


def state_quality(raw: DataFrame) -> DataFrame:
    """Missing index and negatives per state, worst share first."""
    counted = raw.groupBy("state_name").agg(
        F.count(F.lit(1)).alias("measurements"),
        F.count_if(F.col("aqi_raw").isNull()).alias("null_aqi"),
        F.count_if(F.col("pm25_raw") < 0).alias("negative_pm25"),
    )
    return counted.select(
        "state_name",
        "measurements",
        "null_aqi",
        percent_of(F.col("null_aqi"), F.col("measurements"), 2).alias("null_aqi_pct"),
        "negative_pm25",
    ).orderBy(F.desc("null_aqi_pct"), F.asc_nulls_last("state_name"))


def extreme_aqi_rows(raw: DataFrame, config: CleanupConfig = CleanupConfig()) -> DataFrame:
    """Rows whose index exceeds the maximum."""
    return raw.where(F.col("aqi_raw") > config.aqi_max).select(
        *_PLACE, "pm25_raw", "aqi_raw", "site_name"
    )


def _top(df: DataFrame, first: list[Column], columns: list[str], limit: int) -> DataFrame:
    """First rows by ``first``; the other columns only make the order total."""
    return df.orderBy(*first, *[F.col(c).asc_nulls_last() for c in columns]).limit(limit)


def most_negative(raw: DataFrame, limit: int = 15) -> DataFrame:
    shown = [*_PLACE, "pm25_raw", "sample_duration"]
    rows = raw.where(F.col("pm25_raw") < 0).select(*shown)
    return _top(rows, [F.col("pm25_raw").asc()], shown, limit)


def negative_corrections(
    raw: DataFrame, config: CleanupConfig = CleanupConfig(), limit: int | None = 15
) -> DataFrame:
    """Negative concentrations with the corrected value and the size of the correction."""
    fixed = F.greatest(F.col("pm25_raw"), F.lit(float(config.pm25_min)))
    rows = raw.where(F.col("pm25_raw") < 0).select(
        *_PLACE,
        F.col("pm25_raw").alias("pm25_original"),
        fixed.alias("pm25_fixed"),
        F.abs(F.col("pm25_raw") - fixed).alias("correction"),
    )
    if limit is None:
        return rows
    return _top(rows, [F.col("correction").desc()], rows.columns, limit)


def aqi_capping(
    raw: DataFrame, config: CleanupConfig = CleanupConfig(), above: int = 300,
    sensor_error_above: int = 1000,
) -> DataFrame:
    """Rows with a high index, the capped value, the amount cut off, and its class."""
    aqi = F.col("aqi_raw")
    capped = F.least(aqi, F.lit(config.aqi_max).cast("bigint"))
    return raw.where(aqi > above).select(
        *_PLACE,
        aqi.alias("aqi_original"),
        capped.alias("aqi_capped"),
        (aqi - capped).alias("amount_capped"),
        F.when(aqi > sensor_error_above, "SENSOR ERROR")
        .when(aqi > config.aqi_max, "Capped")
        .otherwise("Normal")
        .alias("category"),
    )


def aqi_fill_status(raw: DataFrame, config: CleanupConfig = CleanupConfig()) -> DataFrame:
    """Each row's index, filled from the concentration where missing, and which it was."""
    aqi = F.col("aqi_raw")
    return raw.select(
        "state_name",
        "date_local",
        round_half_up(F.col("pm25_raw"), 2).alias("pm25"),
        aqi.alias("aqi_original"),
        round_half_up(F.coalesce(aqi.cast("double"), aqi_from_pm25(F.col("pm25_raw"))), 4).alias(
            "aqi_calculated"
        ),
        F.when(aqi.isNull(), "Berechnet").otherwise("Original").alias("status"),
    )


def low_observation(
    raw: DataFrame, config: CleanupConfig = CleanupConfig(), limit: int = 15
) -> DataFrame:
    """Rows with the lowest observation percent and their quality flag."""
    rows = raw.where(F.col("observation_percent") < config.unreliable_below).select(
        "state_name",
        "date_local",
        "pm25_raw",
        "aqi_raw",
        "observation_percent",
        quality_flag(config).alias("data_quality_flag"),
    )
    return _top(rows, [F.col("observation_percent").asc()], rows.columns, limit)
