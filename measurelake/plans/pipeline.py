"""The complete cleanup run: read, clean, export, validate, report."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measurelake.model import CleanupConfig, ColumnMap
from measurelake.operators import audit, cleanup
from measurelake.sources import readers, writers

_PROFILED = (
    "state_name", "county_name", "date_local", "pm25_raw", "aqi_raw", "observation_percent",
)


@dataclass
class CleanupRun:
    """Results of a run.  Figures read small tables; ``cleaned``, ``raw`` and ``examples`` are lazy.

    ``working`` names the folders next to the target that hold these tables; they
    belong to the caller.
    """

    raw: DataFrame
    cleaned: DataFrame
    paths: dict[str, str] = field(default_factory=dict)
    working: dict[str, str] = field(default_factory=dict)
    schema: DataFrame | None = None
    examples: DataFrame | None = None
    summary: DataFrame | None = None
    quality: DataFrame | None = None
    audit: DataFrame | None = None
    comparison: DataFrame | None = None
    success: DataFrame | None = None
    sizes: dict[str, DataFrame] = field(default_factory=dict)


def run_cleanup(
    spark: SparkSession,
    source: str,
    target: str,
    config: CleanupConfig = CleanupConfig(),
    columns: ColumnMap | None = None,
    by_month: bool = False,
    mode: str = "error",
) -> CleanupRun:
    """Clean the table at ``source`` and write ``<target>_cleaned.*`` and a report.

    The source is scanned once.  Everything after that reads a Parquet table of
    originals and cleaned values: the export, or ``<target>_tracking.parquet``
    where the export lacks the originals or is CSV only.  Audit figures, label counts
    and the profile come from one pass over it (``<target>_audit_parts.parquet``),
    exact medians from a second one; the audit row (``<target>_audit.parquet``) then
    yields comparison, success and report.  Only the examples read it again, twice.
    Nothing is cached, so a lost executor costs re-reading its splits only.
    """
    columns = columns or ColumnMap()
    cleaned = cleanup.clean(readers.read_first_available(spark, [source], columns), config)
    working: dict[str, str] = {}

    def kept(df: DataFrame, name: str) -> DataFrame:
        working[name] = writers.write_parquet(df, f"{target}_{name}.parquet", mode=mode)
        return spark.read.schema(df.schema).parquet(working[name])

    if config.include_cleanup_flags and config.export_format in ("parquet", "both"):
        paths = writers.export_cleaned(cleaned, target, config, columns, by_month, mode)
        checked = readers.read_parquet(spark, paths["parquet"], columns)
    else:
        checked = kept(cleaned, "tracking")
        paths = writers.export_cleaned(checked, target, config, columns, by_month, mode)
    raw = cleanup.originals(checked)

    labels = ("cleanup_action", "data_quality_flag")
    profiled = [c for c in _PROFILED if c in checked.columns] + ["pm25_original", "aqi_original"]
    parts = kept(audit.audit_parts(checked, config, labels, profiled), "audit_parts")
    both = audit.audit_of_parts(parts, config).crossJoin(  # one row each
        F.broadcast(audit.both_medians(checked)))
    both = kept(both, "audit")

    run = CleanupRun(
        raw=raw,
        cleaned=checked,
        paths=paths,
        working=working,
        summary=cleanup.cleanup_summary(parts, "total_rows"),
        quality=cleanup.quality_distribution(parts, "total_rows"),
        audit=both,
        comparison=audit.before_after_of(both),
        success=audit.cleanup_success_of(both),
        sizes={name: writers.output_size(spark, path) for name, path in paths.items()},
    )
    if config.show_examples:
        run.examples = audit.problem_examples(raw, config)
    if config.verbose:
        counts = parts.withColumnsRenamed(
            {f"_known_{m}_original": f"_known_{m}_raw" for m in ("pm25", "aqi")})
        run.schema = readers.schema_profile(raw, [c for c in _PROFILED if c in raw.columns], counts)
        report = audit.cleanup_report_of(both, config)
        run.paths["report"] = writers.write_report(report, f"{target}_cleanup_report", mode)
    checked.createOrReplaceTempView("cleaned_data")
    return run


def quick_run(
    spark: SparkSession, source: str, target: str, export_format: str = "parquet",
    verbose: bool = True, show_examples: bool = True,
) -> CleanupRun:
    """Run with default rules."""
    config = replace(
        CleanupConfig(), export_format=export_format, verbose=verbose, show_examples=show_examples
    )
    return run_cleanup(spark, source, target, config)


def custom_run(
    spark: SparkSession, source: str, target: str, settings: dict[str, Any]
) -> CleanupRun:
    """Run with the rules given as a dictionary of :class:`CleanupConfig` fields."""
    return run_cleanup(spark, source, target, CleanupConfig(**settings))
