"""Exact top-k inner products by no-random-access aggregation.

Each block of vectors keeps, for every dimension, the list of its vectors sorted
by that component.  For a query the lists are read in turn from the end with the
largest contributions, some entries at a time.  What has been read of a vector,
with the last value read of each other list, bounds its score from above; with
the worst value of each other list, from below.  Reading stops when no vector
outside the k best lower bounds can reach the k-th of them.  The scores of those
that are left are then resolved from the components not yet read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from measurelake.llm.common import map_groups, settle

BLOCK = 2048  # vectors of a block, on average
QUERY_BLOCK = 512
DEPTHS = (8, 4, 2, 1)  # parts of each list that are read before bounds are compared


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, vector): components as floor(scale * x).

    Vectors that are null or hold a null or non-finite component are left out, and so
    are rows with a null id and empty vectors.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    # NaN counts as larger than infinity.
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    return df.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("vector"),
    ).where(F.col(id_col).isNotNull() & F.col("vector").isNotNull() & finite & (F.size("vector") > 0))


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 10
) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of each query.

    Both tables are (vec_id, vector of long); a candidate with the query's own id
    does not count.  Ties go to the smaller id.  Only vectors of the same length
    are compared.  A query with fewer than k candidates gets all of them, one with
    none gets no row.  Rows with the same id and vector count once; rows with the
    same id and other vectors count each, as answers and as questions.  Scores are exact;
    one among the answers that does not fit into 64 bits is an error.  Other columns are
    ignored; an empty table gives an empty result.

    Blocks of candidates meet blocks of queries; a block yields k rows for a query
    at most, and the rows of all blocks are ranked by query.
    """
    queries, candidates = queries.distinct(), settle(candidates.distinct(), "candidates")
    numbers = candidates.agg(F.count(F.lit(1))).first()[0], queries.count()
    blocks, query_blocks = -(-numbers[0] // BLOCK) or 1, -(-numbers[1] // QUERY_BLOCK) or 1

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int, side: int) -> DataFrame:
        return df.select(
            F.size("vector").cast("long").alias("width"),
            F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other),
            F.lit(side).alias("side"), "vec_id", "vector",
        )

    met = dealt(candidates, "block", blocks, "query_block", query_blocks, 1).unionByName(
        dealt(queries, "query_block", query_blocks, "block", blocks, 0))

    def search(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        side, ids = rows.column("side").to_numpy(), rows.column("vec_id").to_numpy()
        vectors, width = rows.column("vector"), rows.column("width").to_numpy()
        found: list[np.ndarray] = [np.empty((0, 3), np.int64)]
        for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            flat = vectors.slice(at, end - at).combine_chunks().flatten().to_numpy()
            all_ = flat.reshape(end - at, width[at])
            asked = side[at:end] == 0
            lists = SortedLists(ids[at:end][~asked], all_[~asked])
            own = ids[at:end][asked]
            for number, best, score in lists.best(all_[asked], own, k):
                found.append(np.column_stack([np.full(len(best), own[number]), best, score]))
        out = np.concatenate(found)
        return pa.RecordBatch.from_arrays(
            [pa.array(out[:, i].astype(np.int64)) for i in range(3)], ["query_id", "vec_id", "score"]
        )

    partial = map_groups(met, ["width", "block", "query_block"], search,
                         "query_id long, vec_id long, score long", ["side", "vec_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _score_bound(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """What the size of no score of a query exceeds, as doubles a little above."""
    if not len(vectors):
        return np.zeros(len(queries))
    most = np.abs(vectors.astype(np.float64)).max(axis=0)
    return np.abs(queries.astype(np.float64)) @ most * (1 + 1e-9)


class SortedLists:
    """A block of vectors with its sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self._ids, self._whole = ids, vectors
        self._vectors = vectors.astype(np.float64)  # exact where scores stay below 2**53
        order = np.argsort(vectors, axis=0, kind="stable")  # ascending, by dimension
        self._values = np.take_along_axis(self._vectors, order, axis=0)
        self._rank = np.empty_like(order)
        places = np.broadcast_to(np.arange(len(vectors))[:, None], order.shape)
        np.put_along_axis(self._rank, order, places, axis=0)

    def best(
        self, queries: np.ndarray, own_ids: np.ndarray, k: int
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's number, ids, scores) of the k best vectors for each query but its own id.

        All queries read the same lists, those with positive components from the top
        and those with negative ones from the bottom, to the same depth at a time.
        """
        n = len(self._ids)
        asked = np.arange(len(queries))
        large = _score_bound(queries, self._whole) >= 2**53
        if large.any():  # beyond what doubles tell apart: lists are read to the end, in whole numbers
            yield from self._read_out(queries, own_ids, k, np.flatnonzero(large))
            asked = asked[~large]
        for depth in sorted({-(-n // part) for part in DEPTHS}) if n else ():
            q = queries[asked].astype(np.float64).T
            upper, lower = self._bounds(np.maximum(q, 0), np.minimum(q, 0), depth)
            own = self._ids[:, None] == own_ids[asked]
            upper[own] = lower[own] = -np.inf
            at = max(n - k, 0)
            floor = np.partition(lower, at, axis=0)[at]
            open_ = (upper >= floor) & ~own  # ties may still win by their id
            done = (open_.sum(axis=0) <= 2 * k) | (depth == n)
            for column in np.flatnonzero(done):
                left = np.flatnonzero(open_[:, column])
                exact = (self._vectors[left] @ q[:, column]).astype(np.int64)
                first = np.lexsort((self._ids[left], -exact))[:k]
                yield int(asked[column]), self._ids[left][first], exact[first]
            asked = asked[~done]
            if not len(asked):
                return

    def _read_out(
        self, queries: np.ndarray, own_ids: np.ndarray, k: int, asked: np.ndarray
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        bound = _score_bound(queries, self._whole)
        for number in asked.tolist():
            kind = np.int64 if bound[number] < 2**63 else object
            scores = self._whole.astype(kind) @ queries[number].astype(kind)
            left = np.flatnonzero(self._ids != own_ids[number])
            first = left[np.lexsort((self._ids[left], -scores[left]))[:k]] if kind is np.int64 else np.array(
                sorted(left.tolist(), key=lambda i: (-scores[i], self._ids[i]))[:k], np.int64)
            if any(not -(2**63) <= s < 2**63 for s in scores[first].tolist()):
                raise OverflowError(f"a score of query {own_ids[number]} does not fit into 64 bits")
            yield number, self._ids[first], scores[first].astype(np.int64)

    def _bounds(
        self, up: np.ndarray, down: np.ndarray, depth: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of all scores when each list has been read to a depth from either end.

        A component not yet read lies between the last value read and the list's other end.
        """
        values, n = self._values, len(self._values)
        top, bottom = self._rank >= n - depth, self._rank < depth
        upper = np.where(top, self._vectors, values[n - depth]) @ up
        upper += np.where(bottom, self._vectors, values[depth - 1]) @ down
        if depth == n:
            return upper, upper.copy()
        lower = np.where(top, self._vectors, values[0]) @ up
        lower += np.where(bottom, self._vectors, values[-1]) @ down
        return upper, lower
