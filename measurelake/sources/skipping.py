"""Layouts and indexes by which a reader leaves out what a question does not touch.

A clustered table is ordered by state, day and site over all its files, so that the
bounds which Parquet keeps of each row group exclude most groups for a state, a period or
both; Bloom filters do the same for names in no order.  A token index says which
files hold a word, for searches that no bound can answer.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurelake.model import ColumnMap
from measurelake.operators.filters import search
from measurelake.sources.writers import write_parquet

CLUSTERED = ("state_name", "date_local", "site_name")
FILTERED = ("state_name", "county_name", "site_name")


def write_clustered(
    cleaned: DataFrame, path: str, columns: ColumnMap | None = None, by: Sequence[str] = CLUSTERED,
    filtered: Sequence[str] = FILTERED, distinct_values: int = 10_000, row_group_bytes: int = 32 << 20,
    mode: str = "error",
) -> str:
    """Write ZSTD Parquet, ordered by ``by`` over all files, with Bloom filters on ``filtered``.

    Rows are dealt by range, so each file has a part of the order; a state with a third
    of all rows is cut by day and site.  ``distinct_values`` sizes the filters of a row group.
    Nulls come first.  Row groups are smaller than usual: they are what is left out.
    """
    columns = columns or ColumnMap()
    keys = [c for c in by if c in cleaned.columns]
    # A last key that differs from row to row lets equal keys be cut, too.
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in cleaned.columns])
    ordered = (cleaned.withColumn("_spread", spread).repartitionByRange(*keys, "_spread")
               .sortWithinPartitions(*keys).drop("_spread"))
    out = columns.to_source(ordered)
    names = columns.pairs()
    writer = out.write.mode(mode).option("compression", "zstd").option("parquet.block.size", row_group_bytes)
    for name in filtered:
        source = names.get(name, name)
        if source in out.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{source}", True).option(
                f"parquet.bloom.filter.expected.ndv#{source}", distinct_values)
    writer.parquet(path)
    return path


# -- words and the files that hold them ------------------------------------------

_PLAIN_TYPES = (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def _folded(text: Column) -> Column:
    """Text in a form in which all spellings are equal that a search regards as equal."""
    # The sigma has two small letters.  In between, it also keeps the two steps apart, which
    # the optimizer would take for one.
    return F.lower(F.translate(F.upper(text), "Σ", "σ"))


def write_token_index(
    spark: SparkSession, table: str, path: str, columns: Sequence[str] | None = None, mode: str = "error"
) -> str:
    """Write (token, file) of every word, between white space, of every column of a Parquet table.

    One row for each file without any word keeps it known.  Distinct values of a column are
    few beside its rows: each column is reduced to those of each file, in a scan of its own
    that reads this column only, before any text is folded and split.
    """
    rows = spark.read.parquet(table)
    told = reduce(DataFrame.union, [_words(_values(rows, c)) for c in columns or rows.columns])
    return write_parquet(told.distinct().repartitionByRange("token", "file").sortWithinPartitions("token"), path, mode=mode)


def _values(rows: DataFrame, column: str) -> DataFrame:
    """(file, value) of the distinct values of a column, as they are if grouping keeps their spelling."""
    value = F.col(f"`{column}`")
    if not isinstance(rows.select(value).schema[0].dataType, _PLAIN_TYPES):
        value = value.cast("string")  # negative zero would become zero, for one
    return rows.select(F.col("_metadata.file_path").alias("file"), value.alias("value")).distinct()


def _words(values: DataFrame) -> DataFrame:
    text = F.coalesce(_folded(F.col("value").cast("string")), F.lit(""))
    return values.select("file", F.explode(F.split(text, r"\s+")).alias("token"))


def files_with(index: DataFrame, term: str) -> DataFrame:
    """(file) of the files that may hold a text; all of them for white space only."""
    parts = re.split(r"[ \t\n\x0b\f\r]+", term)
    wanted = [p for p in parts if p]
    if not wanted:
        return index.select("file").distinct()
    hits = [F.col("token").contains(_folded(F.lit(p))) for p in wanted]
    near = hits[0]
    for hit in hits[1:]:
        near = near | hit
    held = index.where(near).groupBy("file").agg(*[F.max(h).alias(f"_{i}") for i, h in enumerate(hits)])
    whole = F.lit(True)
    for i in range(len(hits)):
        whole = whole & F.col(f"_{i}")
    return held.where(whole).select("file")


def search_indexed(spark: SparkSession, table: str, index: str, term: str) -> DataFrame:
    """Rows of a Parquet table in which a column, as text, holds ``term``, whatever its case.

    The same rows as :func:`measurelake.operators.filters.search` of a literal term finds.
    Only files that may hold it are opened, and files that the index does not know.
    The driver holds names of files, as it does for any table.
    """
    rows = spark.read.parquet(table)
    told = spark.read.parquet(index)
    known = {r["file"] for r in told.select("file").distinct().collect()}
    hit = {r["file"] for r in files_with(told, term).collect()}
    found = [f for f in _listed(spark, table) if f in hit or f not in known]
    if not found:
        return rows.where(F.lit(False))
    near = spark.read.schema(rows.schema).option("basePath", table).parquet(*found)
    return search(near.select(*[F.col(f"`{c}`") for c in rows.columns]), term, literal=True)


def _listed(spark: SparkSession, table: str) -> list[str]:
    """Paths of a table's files in the form in which rows tell theirs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet").load(table).select(F.col("_metadata.file_path").alias("file"))
    return sorted(r["file"] for r in files.collect())
