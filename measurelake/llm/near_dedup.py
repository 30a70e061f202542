"""Near-duplicate documents by a multi-index join of minwise signatures.

A signature has 64 slots of 16 bits; two documents of similarity s differ in a
slot with probability 1 - s.  Pairs that differ in at most 31 slots are found
without exception: the slots fall into 16 chunks of 4, so by the pigeonhole
principle one chunk differs in at most one slot, and each document is listed
under every chunk with each of its slots left out, the allowed chunk errors.
At a similarity of 0.75 a pair differs in 32 slots or more with a probability of
about 1e-5, at 0.8 of below 1e-7.

The pairs only group documents.  Within a group the full shingle sets decide, and of
all their links as many are passed on as it takes to connect what is linked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurelake.llm.common import map_arrow, settle
from measurelake.llm.components import components
from measurelake.llm.files import binary
from measurelake.llm.linking import Sketches, candidate_groups, exact_links
from measurelake.llm.marks import broadcast_marks, mix, rows_of
from measurelake.llm.shingles import shingle_set, signature

SLOTS, CHUNK = 64, 4
DISTANCE = 2 * (SLOTS // CHUNK) - 1  # every chunk with two errors would be one more
PIVOT_DISTANCE = 38  # up to which a document joins the group of a pivot with many in its bucket


class Signatures(Sketches):
    """Signatures of 64 slots, near when at most 31 differ."""

    def compared(self, data: list[bytes], sizes: np.ndarray) -> Callable[[int], np.ndarray]:
        slots = _slots(data)
        return lambda i: (slots != slots[i]).sum(1, dtype=np.uint8) <= DISTANCE

    def pairs(self, a: list[bytes], b: list[bytes], sizes: np.ndarray, relaxed: np.ndarray) -> np.ndarray:
        apart = (_slots(a) != _slots(b)).sum(1)
        return apart <= np.where(relaxed, PIVOT_DISTANCE, DISTANCE)


def _slots(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.uint16).reshape(-1, SLOTS)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of ``docs``.

    Documents are linked when 100 * intersection >= percent * union of their sets
    of 5-word shingles; ``component_id`` is the smallest id reachable over links,
    and the document with that id is ``kept``.

    Null, empty and wordless texts have no shingles, and are linked with nothing
    and kept.  Equal sets are collapsed before any comparison.  Rows with one id
    are one document: their texts are linked through it, and all of them are
    kept or none.  A row with a null id is linked with nothing and kept.
    Other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = settle(
        map_arrow(base, _sign, "doc_id long, n_shingles long, hi long, lo long, signature binary"),
        "signatures",
    )
    same = ["hi", "lo", "n_shingles"]
    distinct = settle(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy(*same, "signature").agg(F.min("doc_id").alias("rep")),
        "distinct",
    )
    listed = settle(map_arrow(distinct.select("rep", "n_shingles", "signature"), _keys,
                              "k long, item long, size long"), "listed")
    payload = distinct.select(F.col("rep").alias("item"), F.col("n_shingles").alias("size"),
                              F.col("signature").alias("data"))
    groups = settle(candidate_groups(listed, payload, Signatures(), percent), "groups")
    links = exact_links(groups, group_sets(groups, base, shingle_set), percent)
    named = signed.select("doc_id", "n_shingles", *same[:2]).join(distinct.select(*same, "rep"), same, "left")
    linked = components(links.union(bridges(named)))
    found = named.join(linked, F.col("rep") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "rep")).select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sign(rows: pa.Table) -> pa.RecordBatch:
    sizes, marks, signatures = [], [], []
    for text in rows.column("text").cast(pa.large_binary()).to_pylist():
        shingles = shingle_set(text)
        sizes.append(len(shingles))
        marks.append(xxhash.xxh3_128_digest(shingles.tobytes()))
        signatures.append(signature(shingles, SLOTS).tobytes() if len(shingles) else None)
    halves = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id").combine_chunks(), pa.array(sizes, pa.int64()),
         pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(signatures, pa.binary())],
        ["doc_id", "n_shingles", "hi", "lo", "signature"],
    )


def _keys(rows: pa.Table) -> pa.RecordBatch:
    """A key for every chunk and every slot left out of it: 48 bits of slots, 6 of place."""
    slots = _slots(rows.column("signature").to_pylist()).astype(np.int64)
    keys = np.empty((len(slots), SLOTS), np.int64)
    for place in range(SLOTS):
        chunk = place - place % CHUNK
        first, second, third = (s for s in range(chunk, chunk + CHUNK) if s != place)
        keys[:, place] = (
            place << 48 | slots[:, first] << 32 | slots[:, second] << 16 | slots[:, third]
        )
    rest = [np.repeat(rows.column(c).to_numpy(), SLOTS) for c in ("rep", "n_shingles")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (keys.ravel(), *rest)], ["k", "item", "size"])


def bridges(named: DataFrame) -> DataFrame:
    """Edges (a, b) between the representatives of rows that share an id: they are one document."""
    of = named.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(
        F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    return of.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a <> b")


def group_sets(groups: DataFrame, base: DataFrame, shingles) -> DataFrame:
    """(item, size, data): the whole sets of the documents of settled groups, settled.

    ``base`` is (doc_id, text).  Tasks are sent a bitmap of the ids, so that texts are
    read where they are and only sets are passed on; a few others may be among them.
    """
    ids = settle(groups.select("node").distinct(), "nodes", groups.count())
    marks = broadcast_marks(ids, lambda rows: _id_hash(rows.column("node").to_numpy()), rows_of(ids))

    def fetch(rows: pa.Table) -> pa.Table:
        number = rows.column("doc_id").to_numpy()
        wanted = pa.array(marks.value.has(_id_hash(number)))
        rows, number = rows.filter(wanted), number[wanted]
        sets = [shingles(text) for text in binary(rows, "text")]
        return pa.table({
            "item": number, "size": pa.array([len(s) for s in sets], pa.int64()),
            "data": pa.array([s.tobytes() for s in sets], pa.binary())})

    found = map_arrow(base.where("doc_id is not null"), fetch, "item long, size long, data binary")
    return settle(found.where("size > 0"), "sets")


def _id_hash(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
