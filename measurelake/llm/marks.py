"""Membership of hashed items in a bounded bitmap that tasks are sent.

A set of any size becomes at most 16 MB.  An item of the set is always found; others
may be found as well, the more so the larger the set, so that whoever asks has to
tell them apart later.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurelake.llm.common import map_arrow, map_groups

LEAST_BITS, MOST_BITS = 16, 27  # powers of two; a set gets 16 bits an item within these
_CHUNK = 15  # power of two of the bits that a row of the gathered map has


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Marks:
    """A bitmap; ``hashes in`` it are 64-bit numbers whose high bits give the place."""

    def __init__(self, power: int, chunks: dict[int, bytes]) -> None:
        self.power = power
        self.bits = np.zeros(1 << (power - 3), np.uint8)
        width = 1 << (min(_CHUNK, power) - 3)
        for chunk, content in chunks.items():
            self.bits[chunk * width : (chunk + 1) * width] = np.frombuffer(content, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.power)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def broadcast_marks(items: DataFrame, hashes: Callable[[pa.Table], np.ndarray], count: int):
    """A broadcast :class:`Marks` of ``count`` settled rows, hashed by a function of a table.

    The driver gets the bitmap, 16 MB at most, whatever the number of items.
    """
    power = min(MOST_BITS, max(LEAST_BITS, (16 * max(count, 1) - 1).bit_length()))
    low = min(_CHUNK, power)

    def place(rows: pa.Table) -> pa.Table:
        at = np.unique(hashes(rows) >> np.uint64(64 - power)).astype(np.int64)
        return pa.table({"chunk": at >> low, "bit": at & ((1 << low) - 1)})

    def gather(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        chunk, bit = rows.column("chunk").to_numpy(), rows.column("bit").to_numpy()
        out = []
        for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            flags = np.zeros(1 << low, bool)
            flags[bit[at:end]] = True
            out.append(np.packbits(flags, bitorder="little").tobytes())
        return pa.table({"chunk": chunk[starts[:-1]], "content": pa.array(out, pa.binary())})

    placed = map_arrow(items, place, "chunk long, bit long").distinct()
    found = map_groups(placed, ["chunk"], gather, "chunk long, content binary")
    chunks = {r["chunk"]: bytes(r["content"]) for r in found.collect()}
    return items.sparkSession.sparkContext.broadcast(Marks(power, chunks))


def rows_of(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
