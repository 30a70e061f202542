"""Helpers shared by the operators: tables, settled intermediate tables, whole groups in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measurelake.sources.writers import gathered, settle, working_path

__all__ = ["blocked", "gathered", "hashed_sample", "keyed", "map_arrow", "map_groups", "run_arrow",
           "settle", "spans", "table", "working_path"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """(_key, _row): each row of ``docs`` with a key of its own, in a settled table.

    Ids may be null or occur in several rows; what is decided of a row is told
    to it by its key.
    """
    row = F.struct(*docs.columns).alias("_row")
    return settle(docs.select(F.monotonically_increasing_id().alias("_key"), row), "rows")


def run_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` in workers that find this package where the driver has it.

    On a cluster without the driver's folders the package is installed or shipped,
    and the extra search path is idle.
    """
    environment = df.sparkSession.sparkContext.environment
    here = str(Path(__file__).resolve().parents[2])
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if here not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, here])
    return df.mapInArrow(run, schema)


def map_arrow(
    df: DataFrame, function: Callable[[pa.Table], pa.Table | pa.RecordBatch], schema: str
) -> DataFrame:
    """Apply a table function to each Arrow batch of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _batches(function(pa.Table.from_batches([batch])))

    return run_arrow(df, run, schema)


def map_groups(
    df: DataFrame, keys: list[str], function: Callable[[pa.Table, np.ndarray], pa.Table],
    schema: str, order: Iterable[str] = (),
) -> DataFrame:
    """Apply a function to whole groups of rows, many groups a call.

    The function gets a table sorted by ``keys`` (then ``order``) and the
    offsets at which its groups start, with the end as last entry.  A group is
    held in memory: callers bound its size.  ``keys`` are long columns.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            if rest is not None:
                now = pa.concat_tables([rest, now])
            starts = spans([now.column(k) for k in keys])
            cut = int(starts[-2])  # the last group may go on in the next batch
            rest = now.slice(cut)
            if cut:
                yield from _batches(function(now.slice(0, cut).combine_chunks(), starts[:-1]))
        if rest is not None:
            last = rest.combine_chunks()
            yield from _batches(function(last, np.array([0, last.num_rows])))

    return run_arrow(dealt, run, schema)


def hashed_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows and never more, those with low hashes of the keys; all, if fewer.

    A cut on the hash comes first, so that each task passes on its share only.
    """
    total = df.count()
    if total <= rows:
        return df
    cut = int((1 << 30) * 0.97 * rows / total)
    low = df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < cut)
    return low.orderBy(F.xxhash64(*keys), *keys).limit(rows)


def spans(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """Offsets at which runs of equal values begin, and the number of rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for column in columns:
        values = column.to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _batches(out: pa.Table | pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if isinstance(out, pa.RecordBatch):
        yield out
    else:
        yield from out.to_batches(max_chunksize=20_000)


def blocked(df: DataFrame, item: str, count: str, block: int) -> DataFrame:
    """Copies of each row for the pairs of blocks of its group that it takes part in.

    A group of ``count`` rows falls into ceil(count / block) blocks by the hash
    of ``item``; adds ``block_a <= block_b`` and ``block_own``.  A group of up to
    ``block`` rows is one pair, (0, 0), and is not copied.
    """
    blocks = F.ceil(F.col(count) / F.lit(block)).cast("long")
    own = F.pmod(F.xxhash64(item), blocks)
    out = df.withColumn("block_own", own)
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return out.withColumns({
        "block_a": F.least("block_own", "_other"), "block_b": F.greatest("block_own", "_other"),
    }).drop("_other")
