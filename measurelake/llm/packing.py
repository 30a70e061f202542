"""Best-fit packing of documents into sequences of bounded length.

Documents of one length are interchangeable, and so are gaps of one size.  The
rounds therefore work on lots (length, count) and (gap, count), of which there
are at most as many as a sequence has tokens, however many documents there are:

1. The documents of each length are ranked, in parallel; the counts make the lots.
2. Rounds run from the longest lot down.  A sweep over the sorted gaps gives a lot
   to its successors: all gaps of the smallest size that still takes it, then of
   the next.  The document with rank r of the lot gets the r-th of these gaps.
   What no gap takes opens sequences.  Gaps are updated before the next round.
3. The rounds yield ranges: ranks a..b of length l lie in sequences s..s+b-a at
   offset o.  A join by length and rank tells every document its place, in parallel.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from measurelake.llm.common import map_arrow, settle
from measurelake.llm.files import binary
from measurelake.llm.tokens import crc32, default_path, encoder

SEQUENCE = 4096
_PART = 100_000  # documents of one length that a task ranks, about
_RANKS = 4096  # of one length that are placed under one key

_PLAN = "length long, first long, last long, sequence long, offset long"


def pieces(
    docs: DataFrame, size: int = SEQUENCE, end_id: int = 1, tokenizer: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32: texts as ids, cut where longer than ``size``.

    A null text counts as empty and has the end id only.
    """
    tokenizer = tokenizer or default_path()

    def cut(rows: pa.Table) -> pa.RecordBatch:
        out: list[tuple] = []
        numbers = rows.column("doc_id").to_pylist()
        texts = encoder(tokenizer).encode_all(binary(rows, "text"))
        for number, ids in zip(numbers, texts, strict=True):
            ids = np.append(ids, np.uint32(end_id))
            for piece, start in enumerate(range(0, len(ids), size)):
                part = ids[start : start + size]
                out.append((number, piece, start, len(part), crc32(part)))
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32() if n == "piece" else pa.int64())
             for n, c in zip(names, zip(*out, strict=True), strict=True)], names
        )

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(
        base, cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(docs: DataFrame, size: int = SEQUENCE, **options) -> DataFrame:
    """Each piece of each document with its ``sequence_id`` and ``offset`` there.

    No sequence has more than ``size`` tokens, and none has a hole.  Options as
    for :func:`pieces`.  Rows with equal or null ids are packed one by one.
    Other columns are ignored; an empty table gives an empty result.
    """
    cut = settle(pieces(docs, size, **options), "pieces")
    lots = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``size``
    ranked = _ranked(cut, max(64, -(-max(lots.values(), default=0) // _PART)))
    ranges = docs.sparkSession.createDataFrame(best_fit(lots, size), _PLAN)
    # By stretches of ranks, so that a length with a third of all pieces is many keys, and
    # a piece meets the ranges of its own stretch only.
    stretch = F.explode(F.sequence(
        F.floor(F.col("first") / F.lit(_RANKS)), F.floor(F.col("last") / F.lit(_RANKS))))
    near = ranges.withColumnRenamed("length", "_length").withColumn("_stretch", stretch)
    placed = ranked.join(
        near,
        (F.col("length") == F.col("_length")) & (F.floor(F.col("rank") / F.lit(_RANKS)) == F.col("_stretch"))
        & F.col("rank").between(F.col("first"), F.col("last")),
    )
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset",
    )


def _ranked(cut: DataFrame, salts: int) -> DataFrame:
    """Adds ``rank``, from 0, among the pieces of the same length.

    A length may hold a third of all pieces: each is ranked in salted parts, and
    the parts' counts (at most lengths times salts) are summed up separately.
    """
    parts = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = parts.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        F.col("length").alias("_len"), F.col("_salt").alias("_part"),
        (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
        .alias("_before"),
    )
    inner = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = parts.withColumn("_row", F.row_number().over(inner).cast("long"))
    joined = numbered.join(
        before, (F.col("length") == F.col("_len")) & (F.col("_salt") == F.col("_part"))
    )
    return joined.withColumn("rank", F.col("_before") + F.col("_row") - F.lit(1))


class _Gaps:
    """Open sequences by gap, as ranges (sequence, count); all of a gap are alike."""

    def __init__(self) -> None:
        self._sizes: list[int] = []
        self._ranges: dict[int, list[tuple[int, int]]] = {}

    def put(self, gap: int, sequence: int, count: int) -> None:
        if not gap:
            return
        if gap not in self._ranges:
            insort(self._sizes, gap)
            self._ranges[gap] = []
        self._ranges[gap].append((sequence, count))

    def take(self, least: int, most: int) -> tuple[int, int, int] | None:
        """(gap, sequence, count): up to ``most`` sequences of the smallest gap >= ``least``."""
        at = bisect_left(self._sizes, least)
        if at == len(self._sizes):
            return None
        gap = self._sizes[at]
        sequence, count = self._ranges[gap].pop()
        if count > most:
            self._ranges[gap].append((sequence + most, count - most))
            count = most
        if not self._ranges[gap]:
            del self._ranges[gap]
            self._sizes.pop(at)
        return gap, sequence, count


def best_fit(lots: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, first rank, last rank, first sequence, offset) for lots {length: count}."""
    return list(_rounds(lots, size))


def _rounds(lots: dict[int, int], size: int) -> Iterator[tuple[int, int, int, int, int]]:
    gaps, opened = _Gaps(), 0
    for length in sorted(lots, reverse=True):
        rank, left = 0, lots[length]
        while left:
            found = gaps.take(length, left)
            if found is None:  # open as many sequences as the rest fills
                fit = size // length
                found = size, opened, -(-left // fit)
                opened += found[2]
            gap, sequence, count = found
            # A gap goes on to be the smallest that fits while it fits, so it is filled at once.
            offset = size - gap
            while left and gap >= length:
                now = min(count, left)
                yield length, rank, rank + now - 1, sequence, offset
                if now < count:
                    gaps.put(gap, sequence + now, count - now)
                rank, left, count = rank + now, left - now, now
                gap, offset = gap - length, offset + length
            gaps.put(gap, sequence, count)
