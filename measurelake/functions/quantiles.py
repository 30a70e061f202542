"""Exact quantiles that no single task has to hold.

``percentile``/``median`` keep every distinct value of a group in the memory of
one task, and ``percentile_approx`` changes results.  Here a group is first
reduced to (value, count) rows, spread over the cluster by value.  A histogram
with a bounded number of cells tells which cell holds each wanted rank.  Each of
these cells is split evenly between its least and greatest value, since close
values share a cell; only the parts that hold a wanted rank are ordered, each in
its own task.

Where groups are known to be few, a mergeable sketch of each group replaces the
histogram: it gives a bracket of values that holds the wanted rank, and a second scan
counts what lies outside and orders what lies inside.  No other value is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Histogram cells per doubling of the value.  A double spans about 2,100 doublings
# on either side of zero; sensor values of 0.01 to 1,000 fill about 17,000 cells.
_CELLS_PER_DOUBLING = 1024.0
_LEAST = 1_100_000  # moves the cell of the smallest positive double above zero
_INFINITE, _NAN = 3_000_000, 4_000_000  # beyond every finite cell; NaN sorts last
_PARTS = 65_536  # of a wanted cell


def _cell(value: Column) -> Column:
    """Histogram cell, non-decreasing in ``value``."""
    size = F.floor(F.log2(F.abs(value)) * F.lit(_CELLS_PER_DOUBLING)) + F.lit(_LEAST)
    cell = F.signum(value) * F.least(size, F.lit(_INFINITE))
    return (
        F.when(F.isnan(value), F.lit(_NAN)).when(F.abs(value) == float("inf"), F.signum(value) * _INFINITE)
        .when(value == 0, F.lit(0)).otherwise(cell).cast("bigint")
    )


def _part(value: Column) -> Column:
    """Part of a wanted cell between its bounds ``_low`` and ``_high``."""
    place = (value - F.col("_low")) / (F.col("_high") - F.col("_low")) * F.lit(float(_PARTS))
    spread = (F.col("_low") < F.col("_high")) & ~F.isnan("_high")
    return F.when(spread, F.least(F.floor(place), F.lit(_PARTS - 1))).otherwise(F.lit(0)).cast("bigint")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    few_groups: bool | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per ``keys``.

    Returns ``keys`` plus one double column per entry of ``probabilities``.
    Nulls are ignored.  Groups without a value have no row, except that without
    keys there is always exactly one row.

    ``few_groups`` says that a row for each group may be broadcast, as without keys: groups
    then are sketched (see :func:`bracketed_quantiles`).  Otherwise the wanted cells, at
    most two per group and quantile, are joined back to the value counts; adaptive
    execution decides by size and splits crowded cells.
    """
    keys = list(keys)
    if few_groups or (few_groups is None and not keys):
        return bracketed_quantiles(df, keys, value, probabilities)
    counts = (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_cell", _cell(F.col("_v")))
    )

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1).cast("double")

    def holds(rank: Column, start: Column, size: Column) -> Column:
        return (rank >= start) & (rank < start + size)

    ranks = [f(position(p)) for p in probabilities.values() for f in (F.floor, F.ceil)]
    any_rank = reduce(or_, [holds(r, F.col("_start"), F.col("_cell_n")) for r in ranks])

    def before(within: list[str], by: str) -> Column:
        upto = Window.partitionBy(*within).orderBy(by).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return F.sum("_cell_n").over(upto) - F.col("_cell_n")

    def inside(rows: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
        # Null-safe, because a null key is a group of its own; and for the cell, so that
        # no null check is pushed below the counts on one side only.  Both sides then
        # are the same shuffle, and the input is read once.
        wanted = cells.where(any_rank).drop("_cell_n").withColumnsRenamed({c: f"_k_{c}" for c in by})
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
        return rows.join(wanted, reduce(and_, same)).drop(*[f"_k_{c}" for c in by])

    cells = (
        counts.groupBy(*keys, "_cell")
        .agg(F.sum("_n").alias("_cell_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        .withColumn("_start", before(keys, "_cell"))
        .withColumn("_total", F.sum("_cell_n").over(Window.partitionBy(*keys)))
    )
    near = inside(counts, cells, [*keys, "_cell"]).withColumn("_part", _part(F.col("_v")))
    parts = (
        near.groupBy(*keys, "_cell", "_part")
        .agg(F.sum("_n").alias("_cell_n"), F.max("_start").alias("_from"), F.max("_total").alias("_total"))
        .withColumn("_start", F.col("_from") + before([*keys, "_cell"], "_part"))
        .drop("_from")
    )
    rows = inside(near.drop("_start", "_total", "_low", "_high"), parts, [*keys, "_cell", "_part"])
    upto = Window.partitionBy(*keys, "_cell", "_part").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ordered = rows.withColumn("_first", F.col("_start") + F.sum("_n").over(upto) - F.col("_n"))

    def at(rank: Column) -> Column:
        return F.max(F.when(holds(rank, F.col("_first"), F.col("_n")), F.col("_v")))

    picks = []
    for name, p in probabilities.items():
        pos = position(p)
        picks += [
            at(F.floor(pos)).alias(f"_lo_{name}"),
            at(F.ceil(pos)).alias(f"_hi_{name}"),
            F.max(pos - F.floor(pos)).alias(f"_f_{name}"),
        ]
    picked = ordered.groupBy(*keys).agg(*picks)
    return picked.select(*keys, *[_interpolated(n) for n in probabilities])


def _interpolated(name: str) -> Column:
    low, high, part = (F.col(f"_{c}_{name}") for c in ("lo", "hi", "f"))
    # Two equal infinities have no difference to interpolate.
    return F.when(low == high, low).otherwise(low + (high - low) * part).alias(name)


# -- brackets ------------------------------------------------------------------

SKETCH = 1024  # parameter k of the sketches: some 24 KB for a group
#: Error of a rank, as a share of the group.  The sketch's own bound of 99 % is
#: 2.296 / k ** 0.9021; at three times that, some eight standard deviations, a miss does
#: not occur in practice, and would be an error and not a wrong figure.
_MARGIN = 3 * 2.296 / SKETCH**0.9021
_SMALL = int(8 / _MARGIN)  # groups up to this size are ordered whole


def bracketed_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float],
    sketched: DataFrame | None = None,
) -> DataFrame:
    """:func:`exact_quantiles` of few groups, in two scans and without shuffling all values.

    The first scan sketches each group.  From the sketch follows a bracket of values for
    each quantile, a few hundredths of the group, and the brackets are broadcast.  The
    second scan keeps the values inside brackets and replaces each of the others by the end of the
    bracket below, so that few distinct ones are left to be counted.  The values inside
    are dealt out in even parts of their bracket, and only parts with a wanted rank are
    ordered.

    ``sketched`` replaces the first scan by sketches stored before, of the same rows:
    ``keys``, ``_sketch``, ``_total`` values, ``_numbers`` that are not NaN, ``_min`` and ``_max`` of these.
    """
    keys = list(keys)
    quantiles = sorted(set(probabilities.values()))
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    number = F.when(~F.isnan("_v"), F.col("_v"))
    told = sketched
    if told is None:
        told = rows.groupBy(*keys).agg(
            F.kll_sketch_agg_double(number, SKETCH).alias("_sketch"), F.count("_v").alias("_total"),
            F.min(number).alias("_min"), F.max(number).alias("_max"), F.count(number).alias("_numbers"))
    whole = (F.col("_numbers") < F.col("_total")) | (F.col("_total") <= _SMALL)

    def end(p: float, otherwise: str) -> Column:
        if not 0 < p < 1:
            return F.col(otherwise)
        return F.when(whole, F.col(otherwise)).otherwise(
            F.kll_sketch_get_quantile_double("_sketch", F.lit(p)))

    ends = [(end(p - _MARGIN, "_min"), end(p + _MARGIN, "_max")) for p in quantiles]
    brackets = told.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], "_total",
        F.array(*[low for low, _ in ends]).alias("_lows"), F.array(*[high for _, high in ends]).alias("_highs"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    joined = rows.join(F.broadcast(brackets), reduce(and_, same)) if keys else rows.crossJoin(F.broadcast(brackets))

    v = F.col("_v")
    inside, below, bracket = F.isnan(v), F.lit(None).cast("double"), F.lit(None).cast("int")
    for i in range(len(quantiles)):
        low, high = F.col("_lows")[i], F.col("_highs")[i]
        within = (v >= low) & (v <= high)
        inside = inside | within
        below = F.when(v > high, high).otherwise(below)
        bracket = F.coalesce(bracket, F.when(within, F.lit(i)))
    low, high = F.col("_lows")[F.col("_bracket")], F.col("_highs")[F.col("_bracket")]
    spread = (low < high) & (F.abs(low) < float("inf")) & (F.abs(high) < float("inf"))
    part = F.when(spread, F.least(F.floor((F.col("_x") - low) / (high - low) * _PARTS), F.lit(_PARTS - 1))).otherwise(0)
    # Values in order: those below all brackets, then by bracket, inside it, and between it and the next.
    place = joined.select(
        *keys, "_total", "_lows", "_highs", F.when(inside, v).otherwise(below).alias("_x"),
        (~inside).alias("_out"),
        F.when(F.isnan(v), F.lit(len(quantiles))).when(inside, bracket)
        .otherwise(_below(v, len(quantiles)) - 1).alias("_bracket"),
    ).withColumn("_part", F.when(F.col("_out"), F.lit(_PARTS)).when(F.isnan("_x"), 0).otherwise(part).cast("bigint"))
    counts = place.groupBy(*keys, "_bracket", "_part", "_x").agg(
        F.count(F.lit(1)).alias("_n"), F.any_value("_total").alias("_total"))

    parts = counts.groupBy(*keys, "_bracket", "_part").agg(
        F.sum("_n").alias("_part_n"), F.max("_total").alias("_total"))
    upto = Window.partitionBy(*keys).orderBy("_bracket", "_part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("_start", F.sum("_part_n").over(upto) - F.col("_part_n"))

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1).cast("double")

    def holds(rank: Column, start: Column, size: Column) -> Column:
        return (rank >= start) & (rank < start + size)

    ranks = [f(position(p)) for p in quantiles for f in (F.floor, F.ceil)]
    wanted = parts.where(reduce(or_, [holds(r, F.col("_start"), F.col("_part_n")) for r in ranks]))
    by = [*keys, "_bracket", "_part"]
    # Two parts for a quantile of a group, at most.
    wanted = wanted.select(*[F.col(c).alias(f"_k_{c}") for c in by], "_start")
    near = counts.join(F.broadcast(wanted), reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]))
    before = Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = near.withColumn("_first", F.col("_start") + F.sum("_n").over(before) - F.col("_n"))

    def at(rank: Column) -> Column:
        found = F.when(F.col("_part") == _PARTS, F.raise_error(F.lit(
            "a quantile lies outside of its bracket"))).otherwise(F.col("_x"))
        return F.max(F.when(holds(rank, F.col("_first"), F.col("_n")), found))

    picks = []
    for name, p in probabilities.items():
        pos = position(p)
        picks += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}"),
                  F.max(pos - F.floor(pos)).alias(f"_f_{name}")]
    return ordered.groupBy(*keys).agg(*picks).select(*keys, *[_interpolated(n) for n in probabilities])


def _below(value: Column, brackets: int) -> Column:
    """How many brackets a value outside of all lies above."""
    return reduce(add, [F.when(value > F.col("_highs")[i], 1).otherwise(0) for i in range(brackets)])
