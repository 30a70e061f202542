"""Cleanup month by month: a rerun replaces the months asked for, and reports on the whole.

Next to the cleaned table stand three small tables in month folders, written in the
same run: audit parts per place and label, mergeable audit states, and the daily
rollup.  The report adds up the parts of all months, so it costs no scan of other
months but one for exact medians, and equals that of a full run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurelake.model import CleanupConfig, ColumnMap
from measurelake.operators import audit, cleanup, rollup
from measurelake.sources import readers, writers

LABELS = ("cleanup_action", "data_quality_flag")


@dataclass
class MonthRun:
    """Tables after a run: the cleaned one, its parts, and figures of all months, lazily."""

    cleaned: DataFrame
    rollup: DataFrame
    parts: DataFrame
    states: DataFrame
    audit: DataFrame
    summary: DataFrame
    quality: DataFrame
    success: DataFrame
    report: DataFrame
    paths: dict[str, str] = field(default_factory=dict)


def _first(month: date) -> date:
    return month.replace(day=1)


def _next(month: date) -> date:
    return date(month.year + month.month // 12, month.month % 12 + 1, 1)


def in_months(column: str, months: Sequence[date]) -> Column:
    """Rows of the months of the given days, as ranges that reach the files."""
    day = F.col(column)
    ranges = [(day >= F.lit(_first(m))) & (day < F.lit(_next(m))) for m in months]
    return reduce(or_, ranges, F.lit(False))


def run_months(
    spark: SparkSession, source: str, target: str, months: Sequence[date] | None = None,
    config: CleanupConfig = CleanupConfig(), columns: ColumnMap | None = None,
) -> MonthRun:
    """Clean the given months of ``source`` into ``<target>_cleaned.parquet``, by default all.

    A month is given by any of its days.  Of the months asked for, folders are replaced
    together when their job is committed, and folders of months without rows are
    removed; all other folders are left alone.  A run that failed, or is repeated, gives
    the same tables when it is run again.  Readings without a date belong to no month
    and are written by full runs only.

    The source is read once, for these months only where its files allow it.  What is
    derived reads the months back from the cleaned table.
    """
    columns = columns or ColumnMap()
    paths = {name: f"{target}_{name}.parquet" for name in ("cleaned", "parts", "states", "rollup")}
    rows = readers.read_first_available(spark, [source], columns)
    if months is not None:
        months = sorted({_first(m) for m in months})
        rows = rows.where(in_months("date_local", months))
    cleaned = cleanup.clean(rows, config)
    before = writers.month_files(spark, paths["cleaned"], months or ())
    writers.write_months(columns.to_source(cleaned), paths["cleaned"], columns.date_local, months is None)
    # What a month had before and still has was not replaced: it has no rows any more.
    after = writers.month_files(spark, paths["cleaned"], months or ())
    gone = [m for m in before if before[m] & after[m]]
    writers.drop_months(spark, paths["cleaned"], gone)

    # The schema is told, as a table may be without any file.
    table = spark.read.schema(_with_folders(columns.to_source(cleaned))).parquet(paths["cleaned"])
    fresh = columns.to_canonical(table if months is None else table.where(_in_folders(months)))
    derived = _derived(fresh, config)
    for name, df in derived.items():
        writers.write_months(df, paths[name], "date_local" if name == "rollup" else "month_start", months is None)
        writers.drop_months(spark, paths[name], gone)
    return month_figures(spark, paths, config, columns, {"cleaned": columns.to_source(cleaned), **derived})


def _derived(cleaned: DataFrame, config: CleanupConfig) -> dict[str, DataFrame]:
    dated = cleaned.withColumn("month_start", F.trunc("date_local", "month"))
    return {
        "parts": audit.audit_parts(dated, config, ("month_start", *LABELS)),
        "states": audit.audit_states(dated, config, ["month_start"]),
        "rollup": rollup.daily_rollup(cleaned),
    }


def _with_folders(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, T.IntegerType()) for n in ("year", "month")]])


def _in_folders(months: Sequence[date]) -> Column:
    same = [(F.col("year") == m.year) & (F.col("month") == m.month) for m in months]
    return reduce(or_, same, F.lit(False))


def month_figures(
    spark: SparkSession, paths: dict[str, str], config: CleanupConfig = CleanupConfig(),
    columns: ColumnMap | None = None, like: dict[str, DataFrame] | None = None,
) -> MonthRun:
    """The figures of tables that :func:`run_months` has written; ``like`` tells their schemas."""
    def stored(name: str) -> DataFrame:
        reader = spark.read.schema(_with_folders(like[name])) if like else spark.read
        return reader.parquet(paths[name]).drop("year", "month")

    table = (columns or ColumnMap()).to_canonical(stored("cleaned"))
    parts, states = stored("parts"), stored("states")
    row = audit.audit_of_parts(parts, config).crossJoin(  # one row each
        F.broadcast(audit.medians_of_states(states, table)))
    return MonthRun(
        cleaned=table, rollup=stored("rollup"), parts=parts, states=states,
        audit=row,
        summary=cleanup.cleanup_summary(parts, "total_rows"),
        quality=cleanup.quality_distribution(parts, "total_rows"),
        success=audit.cleanup_success_of(row),
        report=audit.cleanup_report_of(row, config),
        paths=paths,
    )
