"""Anomaly flags and trend direction for any table or series.

Flags join the limits of each group back to its rows.  A window would be
shorter to write, but it sorts every group whole into one task.  Limits and
flags are lazy.  Between them :func:`settle_limits` may write the limits: their
true size then decides the join, and the large side is shuffled only if they are
too many to broadcast.  Without it adaptive execution decides, which splits a
group that holds many of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from measurelake.functions.quantiles import exact_quantiles
from measurelake.functions.scalar import divide
from measurelake.sources.writers import write_parquet

_LIMITS = {"zscore": ("_mean", "_std"), "iqr": ("_q1", "_q3")}


def _known(method: str) -> str:
    if method not in _LIMITS:
        raise ValueError(f"unknown method: {method!r}")
    return method


def anomaly_limits(
    df: DataFrame, column: str, method: str = "zscore", keys: Sequence[str] = ()
) -> DataFrame:
    """What :func:`flags` compares with: one row per group, without keys one row."""
    if _known(method) == "iqr":
        return exact_quantiles(df, keys, column, {"_q1": 0.25, "_q3": 0.75})
    value = F.col(column)
    return df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))


def settle_limits(limits: DataFrame, folder: str) -> DataFrame:
    """Run a job that writes the limits to ``folder``, which must not exist; read them back.

    The folder belongs to the caller, who removes it when the flags are done
    with; every executor has to reach it.
    """
    write_parquet(limits, folder)
    return limits.sparkSession.read.schema(limits.schema).parquet(folder)


def flags(
    df: DataFrame, limits: DataFrame, column: str, method: str = "zscore",
    threshold: float = 3.0, keys: Sequence[str] = (),
) -> DataFrame:
    """``df`` with ``is_anomaly`` against the limits of its groups; starts no job.

    ``zscore`` adds ``anomaly_score`` too, the absolute population z-score, and
    flags scores above the threshold.  Null values, and groups with one value
    only, have no score and no flag.  ``iqr`` flags what lies outside the
    quartiles by more than ``threshold`` times their distance.
    """
    value, (low, high) = F.col(column), _LIMITS[_known(method)]
    if keys:
        named = limits.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        joined = df.join(named, same, "left").drop(*[f"_k_{k}" for k in keys])
    else:  # a global aggregate, one row
        joined = df.crossJoin(F.broadcast(limits))
    if method == "zscore":
        joined = joined.withColumn("anomaly_score", F.abs(divide(value - F.col(low), F.col(high))))
        outside = F.col("anomaly_score") > threshold
    else:
        reach = F.lit(float(threshold)) * (F.col(high) - F.col(low))
        outside = (value < F.col(low) - reach) | (value > F.col(high) + reach)
    return joined.withColumn("is_anomaly", F.coalesce(outside, F.lit(False))).drop(low, high)


def detect_anomalies(
    df: DataFrame, column: str, method: str = "zscore", threshold: float = 3.0,
    keys: Sequence[str] = (), settled: str | None = None,
) -> DataFrame:
    """Limits and flags in one call; lazy, unless ``settled`` names a folder for the limits."""
    limits = anomaly_limits(df, column, method, keys)
    if settled:
        limits = settle_limits(limits, settled)
    return flags(df, limits, column, method, threshold, keys)


def trend_direction(
    series: DataFrame, value: str, order: str, keys: Sequence[str] = (), stable_below: float = 1.0
) -> DataFrame:
    """Least-squares slope over the row index as percent of the mean, and its direction.

    ``series`` has one row per time step, so a group is bounded by the calendar.
    Fewer than two rows, or a mean of zero, count as stable.
    """
    index = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    fitted = series.withColumn("_i", index.cast("double")).groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.regr_slope(F.col(value).cast("double"), F.col("_i")).alias("_slope"),
        F.avg(value).alias("_mean"),
    )
    pct = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(
        F.coalesce(divide(F.col("_slope"), F.col("_mean")) * 100.0, F.lit(0.0))
    )
    return fitted.withColumn("trend_pct", pct).select(
        *keys,
        "n",
        "trend_pct",
        F.when(F.abs("trend_pct") < stable_below, "stable")
        .when(F.col("trend_pct") > 0, "increasing")
        .otherwise("decreasing")
        .alias("direction"),
    )
