"""Binary files written and read by Spark's own sources, on any store it reaches.

The text source writes a row's bytes as they are and one separator byte after
them; with one row to a file the separator is the file's last byte, which
readers skip.  Files are committed with their job: a retried or speculative task
leaves no second copy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_files(contents: DataFrame, column: str, path: str, separator: str = "\n") -> str:
    """Write each non-null value of a binary column as a file of its own."""
    (contents.where(F.col(column).isNotNull())
     .select(F.col(column).cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("lineSep", separator).text(path))
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files below a folder; empty ones are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.where("length > 0").select("path", "content")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files below a folder, without reading them; empty ones are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.where("length > 0").select("path", "length")


class RangeReader:
    """Reads ranges of a file by its URI, on any store for which Arrow has a file system."""

    def __init__(self, path: str) -> None:
        scheme, _, rest = path.partition(":")
        rest = quote(rest)  # Spark tells paths as they are
        system, at = fs.FileSystem.from_uri(f"{scheme}:{'' if rest.startswith('//') else '//'}{rest}")
        self._file = system.open_input_file(at)

    def read(self, offset: int, size: int) -> bytes:
        return self._file.read_at(size, offset)

    def read_all(
        self, ranges: Sequence[tuple[int, int]], gap: int = 1 << 16, most: int = 1 << 23
    ) -> Iterator[bytes]:
        """Ranges (offset, size) in ascending order; neighbours share a request."""
        first = 0
        while first < len(ranges):
            start, end, last = ranges[first][0], sum(ranges[first]), first + 1
            while last < len(ranges) and ranges[last][0] <= end + gap and sum(ranges[last]) - start <= most:
                end, last = max(end, sum(ranges[last])), last + 1
            held = self.read(start, end - start)
            for offset, size in ranges[first:last]:
                yield held[offset - start : offset - start + size]
            first = last

    def __enter__(self) -> RangeReader:
        return self

    def __exit__(self, *error: object) -> None:
        self._file.close()


def binary(rows: pa.Table, column: str) -> list[bytes | None]:
    """Values of a string or binary column as bytes."""
    return rows.column(column).cast(pa.large_binary()).to_pylist()
