"""Writing cleaned tables, query results and reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measurelake.model import CleanupConfig, ColumnMap

_TRACKING = ("pm25_original", "aqi_original", "data_quality_flag", "cleanup_action")


def export_projection(cleaned: DataFrame, include_cleanup_flags: bool = True) -> DataFrame:
    """Columns of an export: all, or the raw layout filled with cleaned values."""
    if include_cleanup_flags:
        return cleaned
    return cleaned.drop(*_TRACKING).withColumnsRenamed(
        {"pm25_cleaned": "pm25_raw", "aqi_cleaned": "aqi_raw"}
    )


def write_parquet(
    df: DataFrame, path: str, month_of: str | None = None, mode: str = "error"
) -> str:
    """Write ZSTD Parquet, optionally in year=/month= folders of the date column ``month_of``.

    Without folders the write is a narrow stage.  With folders the rows are
    first rebalanced by month, so that a month is a few right-sized files and
    not one file per task; rebalancing splits an oversized month.
    """
    if month_of:
        day = F.col(f"`{month_of}`")
        df = df.withColumns({"year": F.year(day), "month": F.month(day)})
        df = df.hint("rebalance", "year", "month")
    writer = df.write.mode(mode).option("compression", "zstd")
    if month_of:
        writer = writer.partitionBy("year", "month")
    writer.parquet(path)
    return path


def write_months(df: DataFrame, path: str, month_of: str, replace_all: bool = False) -> str:
    """Write ZSTD Parquet in month folders, replacing the months that ``df`` has rows of.

    Other months of an existing table stay as they are, unless ``replace_all``.  The
    folders are swapped when the job is committed: a failed or repeated run leaves no
    rows twice.  Null dates have a folder of their own.
    """
    day = F.col(f"`{month_of}`")
    dealt = df.withColumns({"year": F.year(day), "month": F.month(day)}).hint("rebalance", "year", "month")
    (dealt.write.mode("overwrite").option("compression", "zstd")
     .option("partitionOverwriteMode", "static" if replace_all else "dynamic")
     .partitionBy("year", "month").parquet(path))
    return path


def _month_folders(spark: SparkSession, path: str, months: Iterable[date]):
    """(month, file system, folder) of each month."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for month in months:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
            f"{path.rstrip('/')}/year={month.year}/month={month.month}")
        yield month, folder.getFileSystem(conf), folder


def month_files(spark: SparkSession, path: str, months: Iterable[date]) -> dict[date, set[str]]:
    """Names of the files in month folders; none where a folder is missing."""
    return {month: {s.getPath().getName() for s in system.listStatus(folder)} if system.exists(folder) else set()
            for month, system, folder in _month_folders(spark, path, months)}


def drop_months(spark: SparkSession, path: str, months: Iterable[date]) -> None:
    """Remove month folders of a table, those that are there."""
    for _, system, folder in _month_folders(spark, path, months):
        system.delete(folder, True)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    """Write CSV with a header in every part file.

    Quotes are doubled, blanks around values are kept, and empty text is written
    as ``""``, so that it differs from null.
    """
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    for side in ("ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"):
        writer = writer.option(side, False)
    writer.option("nullValue", "").option("emptyValue", '""').csv(path)
    return path


def export_cleaned(
    cleaned: DataFrame,
    target: str,
    config: CleanupConfig = CleanupConfig(),
    columns: ColumnMap | None = None,
    by_month: bool = False,
    mode: str = "error",
) -> dict[str, str]:
    """Write the cleaned table as ``<target>_cleaned.parquet`` and/or ``.csv``.

    With both formats the CSV is written from the finished Parquet, so the
    source is read once.
    """
    columns = columns or ColumnMap()
    out = columns.to_source(export_projection(cleaned, config.include_cleanup_flags))
    paths: dict[str, str] = {}
    if config.export_format in ("parquet", "both"):
        month_of = columns.date_local if by_month else None
        paths["parquet"] = write_parquet(out, f"{target}_cleaned.parquet", month_of, mode)
        out = cleaned.sparkSession.read.parquet(paths["parquet"])
        if by_month:
            out = out.drop("year", "month")
    if config.export_format in ("csv", "both"):
        paths["csv"] = write_csv(out, f"{target}_cleaned.csv", mode)
    return paths


def output_size(spark: SparkSession, path: str) -> DataFrame:
    """Files and size in MB below ``path``; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "part-*")
        .load(path)
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("length") / F.lit(1024.0 * 1024.0), F.lit(0.0)).alias("size_mb"),
        )
    )


def write_report(report: DataFrame, path: str, mode: str = "error") -> str:
    """Write a (section, key, value) report, a few dozen rows, as one text file."""
    lines = report.select(
        F.concat(F.col("section"), F.lit("  "), F.col("key"), F.lit(": "),
                 F.coalesce("value", F.lit(""))).alias("line")
    )
    lines.coalesce(1).write.mode(mode).text(path)
    return path


ROWS_A_FILE = 100_000


def settle(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Its size is then known from its files: a join broadcasts it while it is
    below Spark's threshold, and shuffles otherwise.  A lost executor costs
    re-reading it, not recomputing it.  ``rows`` is a number that the table's rows
    do not exceed, where it is known; see :func:`gathered`.
    """
    if rows is not None:
        df = gathered(df, rows)
    path = write_parquet(df, working_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows at most in as many tasks as these need, and the cluster has cores.

    A file or task of a few rows costs what one of thousands does.  Tasks are merged
    without a shuffle, and never become more.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))


def working_path(spark: SparkSession, name: str) -> str:
    """A fresh path for intermediate tables in the folder shared by the cluster.

    Uses ``spark.checkpoint.dir``, which every session has to set.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
