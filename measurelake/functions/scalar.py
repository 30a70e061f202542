"""Scalar column expressions: rounding, guarded division, calendar labels, bands.

All of them are built-in expressions, so they stay inside whole-stage codegen
and work unchanged on batch and streaming DataFrames.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper concentration of a segment, its lower end, the index at
# the lower end, and the index rise over the concentration rise.
AQI_SEGMENTS = [
    # upto, base concentration, base index, index rise, concentration rise
    (12.0, 0.0, 0.0, 50.0, 12.0),
    (35.4, 12.0, 50.0, 49.0, 23.4),
    (55.4, 35.4, 100.0, 49.0, 20.0),
    (150.4, 55.4, 150.0, 49.0, 95.0),
    (250.4, 150.4, 200.0, 99.0, 100.0),
    (None, 250.4, 300.0, 199.0, 250.0),
]

# Index bands, with the prefix that makes them sort.
AQI_BANDS = [
    (50, "1. Good (0-50)"),
    (100, "2. Moderate (51-100)"),
    (150, "3. Unhealthy Sensitive (101-150)"),
    (200, "4. Unhealthy (151-200)"),
    (300, "5. Very Unhealthy (201-300)"),
    (None, "6. Hazardous (301-500)"),
]

# Concentration levels in µg/m³.
PM25_LEVELS = [
    (12.0, "safe"),
    (35.4, "moderate"),
    (55.4, "unhealthy"),
    (150.4, "very_unhealthy"),
    (250.4, "hazardous"),
    (None, "beyond_hazardous"),
]

# Weekday names, Sunday = 0.
WEEKDAYS = ["Sonntag", "Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag"]


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Round a double half away from zero on its binary value.

    ``F.round`` rounds the shortest decimal text of a double (1.005 -> 1.01);
    the results to match round the binary value (1.005 -> 1.0).  Negative zero
    is normalised, null stays null, NaN and infinities pass through.
    """
    scale = float(10**digits)
    finest = 2.0**52 / scale  # from here on a double has no further digits to round
    rounded = F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale + F.lit(0.0)
    return F.when(F.abs(value) < finest, rounded).otherwise(value)


def divide(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, null where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent_of(part: Column, whole: Column, digits: int) -> Column:
    return round_half_up(divide(part * F.lit(100.0), whole), digits)


def _ladder(value: Column, steps: list[tuple], strict_null: str | None = None) -> Column:
    """First step whose upper bound is not exceeded; the open last step otherwise."""
    expr = F.when(value.isNull(), F.lit(strict_null)) if strict_null is not None else None
    for upto, label in steps[:-1]:
        branch = value <= F.lit(upto)
        expr = F.when(branch, label) if expr is None else expr.when(branch, label)
    return expr.otherwise(steps[-1][1])


def aqi_from_pm25(pm25: Column) -> Column:
    """Air-quality index of a concentration on the piecewise-linear scale."""
    steps = []
    for upto, base, index, rise, run in AQI_SEGMENTS:
        steps.append((upto, F.lit(index) + (pm25 - F.lit(base)) * F.lit(rise) / F.lit(run)))
    return _ladder(pm25, steps)


def aqi_band(aqi: Column, null_label: str | None = None) -> Column:
    """Band label of an index.  A null index falls into the last band unless
    ``null_label`` names another label for it."""
    return _ladder(aqi, [(u, F.lit(t)) for u, t in AQI_BANDS], null_label)


def pm25_level(pm25: Column) -> Column:
    """Level label of a concentration; null stays null."""
    return F.when(pm25.isNotNull(), _ladder(pm25, [(u, F.lit(t)) for u, t in PM25_LEVELS]))


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"))


def weekday_number(day: Column) -> Column:
    """Sunday = 0 ... Saturday = 6."""
    return (F.dayofweek(day) - 1).cast("bigint")


def weekday_name(number: Column) -> Column:
    names = F.create_map(*chain.from_iterable((F.lit(i), F.lit(n)) for i, n in enumerate(WEEKDAYS)))
    return names[number.cast("int")]


def season(day: Column) -> Column:
    """Meteorological season: winter is December to February."""
    month = F.month(day)
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .when(month.isin(9, 10, 11), "Fall")
    )


def number_draw(*key: Column) -> Column:
    """Pseudo-random number that depends only on ``key``.

    Unlike ``rand(seed)`` it does not depend on how rows are spread over
    partitions, so a retried task draws the same.
    """
    return F.shiftrightunsigned(F.xxhash64(*key), 1)


def number_range(draw: Column) -> Column:
    """Which of 65,536 equal ranges a number was drawn from."""
    return F.shiftright(draw, 47)


def text_draw(*key: Column) -> Column:
    """The same as an MD5 of the text of ``key``: slower, but equal in any engine."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("~")) for k in key])
    return F.md5(text)


def text_range(draw: Column) -> Column:
    return F.substring(draw, 1, 4)


def stable_normal(*key: Column) -> Column:
    """Standard-normal number that depends only on ``key`` (Box-Muller on two draws)."""

    def uniform(salt: str) -> Column:  # 13 hexadecimal digits, 52 bits
        digits = F.substring(text_draw(F.lit(salt), *key), 1, 13)
        return (F.conv(digits, 16, 10).cast("double") + 1.0) / float(2**52)

    radius = F.sqrt(F.lit(-2.0) * F.log(uniform("u")))
    return radius * F.cos(F.lit(6.283185307179586) * uniform("v"))
