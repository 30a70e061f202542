"""Reading raw and cleaned measurement tables from any URI Spark can read."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurelake.model import CLEANED_TYPES, RAW_TYPES, ColumnMap

#: what the parser puts for a cell without anything, so that it differs from ``""``
NULL_CELL = "\0"

_TYPES = {**RAW_TYPES, **CLEANED_TYPES}


def read_csv(
    spark: SparkSession, path: str, columns: ColumnMap | None = None, mode: str = "FAILFAST",
    multiline: bool = False,
) -> DataFrame:
    """Read a measurement CSV with a header, in any column order.

    Only the header line is looked at to build the schema: mapped columns get
    their declared types, others are read as text and pruned by the optimizer.
    ``enforceSchema=false`` makes a file with another column order fail instead
    of being read by position, and ``FAILFAST`` does the same for bad cells.
    Quotes within quoted cells are doubled, blanks are kept; a cell without
    anything is null, and ``""`` is empty text.  ``multiline`` reads cells with line
    breaks; such a file cannot be split among tasks, so it is off by default.
    """
    columns = columns or ColumnMap()
    reader = _options(spark, multiline)
    header = reader.csv(path).columns
    df = reader.schema(_typed(header, columns)).option("enforceSchema", False).option("mode", mode).csv(path)
    return columns.to_canonical(df)


def _options(spark: SparkSession, multiline: bool = False) -> DataFrameReader:
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    return reader.option("nullValue", NULL_CELL).option("emptyValue", "")


def _typed(header: Sequence[str], columns: ColumnMap) -> T.StructType:
    wanted = {source: _TYPES[name] for name, source in columns.pairs().items()}
    return T.StructType([T.StructField(h, wanted.get(h, T.StringType())) for h in header])


def csv_layouts(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """header -> the files below ``path`` that have it, for a file, a folder or a glob.

    Files are listed without their contents.  Of each the driver reads the first line
    only, as it would read the footer of a Parquet file; the result has a row for a file.
    Empty files are left out.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = [r["path"] for r in listed.where("length > 0").select("path").collect()]
    first = [_first_line(spark, file) for file in sorted(files)]
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(sorted(files), first, strict=True):
        # As written by the CSV source: quotes are doubled.
        header = tuple(next(csv.reader([line.removeprefix("\ufeff")])))
        layouts.setdefault(header, []).append(file)
    return layouts


def _first_line(spark: SparkSession, file: str) -> str:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(file)
    stream = at.getFileSystem(conf).open(at)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
        codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def read_csv_folder(
    spark: SparkSession, path: str, columns: ColumnMap | None = None, mode: str = "FAILFAST",
) -> DataFrame:
    """Read files of different column orders, with and without columns, as one table.

    Files of one header share a reader, and the readers' tables are united by
    name: a column that a file lacks is null there, one that no map names is left out.
    A file with none of the mapped columns is an error and not a file of nulls.
    """
    return _united(_layout_tables(spark, path, columns, mode))


def _layout_tables(
    spark: SparkSession, path: str, columns: ColumnMap | None, mode: str, corrupt: str | None = None
) -> list[DataFrame]:
    columns = columns or ColumnMap()
    known = set(columns.pairs().values())
    tables = []
    for header, files in sorted(csv_layouts(spark, path).items()):
        if not known & set(header):
            raise ValueError(f"{files[0]}: no known column among {', '.join(header)}")
        schema = _typed(header, columns)
        reader = _options(spark).option("mode", mode)
        also: tuple[str, ...] = ()
        if corrupt:
            schema = schema.add(corrupt, T.StringType())
            reader = reader.option("columnNameOfCorruptRecord", corrupt).option("columnPruning", False)
            also = (corrupt, "_file", "_header")
        # Within a layout the header is known, so the schema is applied by position.
        df = reader.schema(schema).csv(files)
        if corrupt:
            df = df.select("*", F.col("_metadata.file_path").alias("_file"),
                           F.lit(json.dumps(list(header))).alias("_header"))
        tables.append(columns.to_canonical(df, also))
    return tables


def _united(tables: Sequence[DataFrame]) -> DataFrame:
    if not tables:
        raise FileNotFoundError("no file with a header")
    found = {f.name: f.dataType for t in tables for f in t.schema.fields}
    ordered = [n for n in _TYPES if n in found] + [n for n in found if n not in _TYPES]
    filled = [t.select(*[(F.col(n) if n in t.columns else F.lit(None).cast(found[n])).alias(n) for n in ordered])
              for t in tables]
    return reduce(DataFrame.unionAll, filled)


_CORRUPT = "_corrupt_line"


def _parsed(rows: DataFrame) -> Column:
    """True, and a reference to every column: the source parses, and so rejects, what is referred to."""
    cells = [F.col(c).cast("string") for c in rows.columns if c not in (_CORRUPT, "_file", "_header")]
    return F.length(F.concat_ws("", *cells)) >= 0


def read_csv_checked(
    spark: SparkSession, path: str, columns: ColumnMap | None = None
) -> tuple[DataFrame, DataFrame]:
    """(table, rejects) of CSV files: lines with a bad cell abort nothing and do not vanish.

    The table has the lines of which every mapped cell has its type.  A rejected line comes as
    ``file``, ``line`` (its text) and ``reason``: ``cells`` where it has more or fewer cells
    than the header, else ``type:`` and the columns, under their source names, that do not
    parse.  Both sides read the files, each once.  Whole lines are parsed whatever columns
    are selected, since what is rejected must not depend on that.
    """
    columns = columns or ColumnMap()
    tables = _layout_tables(spark, path, columns, "PERMISSIVE", _CORRUPT)
    whole = _united(tables)
    table = whole.where(F.col(_CORRUPT).isNull() & _parsed(whole)).drop(_CORRUPT, "_file", "_header")
    wanted = {source: _TYPES[name] for name, source in columns.pairs().items()}
    rejected = []
    for header, rows in zip(sorted(csv_layouts(spark, path)), tables, strict=True):
        bad = rows.where(F.col(_CORRUPT).isNotNull() & _parsed(rows))
        text = ", ".join(f"c{i} string" for i in range(len(header) + 1))
        options = {"escape": '"', "mode": "PERMISSIVE", "nullValue": NULL_CELL, "emptyValue": ""}
        cells = F.from_csv(F.col(_CORRUPT), text, options).alias("cells")
        bad = bad.select("_file", F.col(_CORRUPT).alias("line"), cells)
        surplus = F.col(f"cells.c{len(header)}").isNotNull()
        wrong = [
            F.when(F.col(f"cells.c{i}").isNotNull() & F.col(f"cells.c{i}").try_cast(wanted[name]).isNull(), F.lit(name))
            for i, name in enumerate(header) if not isinstance(wanted.get(name, T.StringType()), T.StringType)]
        found = F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")
        reason = F.when(surplus | (F.size(found) == 0), F.lit("cells")).otherwise(
            F.concat(F.lit("type: "), F.array_join(found, ", ")))
        rejected.append(bad.select(F.col("_file").alias("file"), "line", reason.alias("reason")))
    return table, reduce(DataFrame.unionAll, rejected)


def read_parquet(
    spark: SparkSession, path: str, columns: ColumnMap | None = None, keep_folders: bool = False
) -> DataFrame:
    """Read a measurement Parquet table; column pruning and pushdown reach the files.

    With ``keep_folders`` the columns year and month of month folders follow the
    canonical ones, and :func:`~measurelake.operators.filters.apply_filter` reads
    only the folders that its dates touch.
    """
    df = spark.read.parquet(path)
    canonical = (columns or ColumnMap()).to_canonical
    return canonical(df, ("year", "month")) if keep_folders else canonical(df)


def read_first_available(
    spark: SparkSession, paths: Sequence[str], columns: ColumnMap | None = None
) -> DataFrame:
    """Open the first path that exists, Parquet before CSV by the order given."""
    for path in paths:
        name = path.rstrip("/").lower()
        read = read_csv if name.endswith((".csv", ".csv.gz")) else read_parquet
        try:
            return read(spark, path, columns)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of these exist: {', '.join(paths)}")


def schema_profile(
    df: DataFrame, names: Sequence[str] | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """One row per column of interest: its declared type and its non-null rows.

    The type is taken from the rows (``typeof``), so a view whose declared and
    produced types differ would show here.  ``counts`` are numbers of non-null rows
    found before, as columns ``_known_<name>`` to sum up; types are then those
    declared and ``df`` is not read.
    """
    names = list(names or df.columns)
    declared = dict(df.dtypes)
    if counts is None:
        counted = df.agg(
            *[F.max(F.typeof(F.col(c))).alias(f"t_{c}") for c in names],
            *[F.count(F.col(c)).alias(f"n_{c}") for c in names],
        )
    else:
        counted = counts.agg(
            *[F.lit(None).cast("string").alias(f"t_{c}") for c in names],
            *[F.coalesce(F.sum(f"_known_{c}"), F.lit(0)).alias(f"n_{c}") for c in names],
        )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.coalesce(f"t_{c}", F.lit(declared[c])).alias("column_type"),
                F.col(f"n_{c}").alias("non_null_rows"),
            )
            for c in names
        ]
    )
    return counted.select(F.inline(rows))


def require_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Return ``df``, or raise naming the columns that are missing or of another type."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, "
        f"found {actual[f.name].simpleString() if f.name in actual else 'no such column'}"
        for f in expected.fields
        if actual.get(f.name) != f.dataType
    ]
    if wrong:
        raise TypeError("; ".join(wrong))
    return df
