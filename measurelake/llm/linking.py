"""Which items of common lists are linked, without comparing all pairs of a long list.

Two uses: items that stand under a common key, told apart by sketches
(:func:`candidate_groups`), and members of a group, told apart by their whole sets
(:func:`exact_links`).  Both answer with edges that connect what is linked, not with all
links.  A short list is compared pair by pair.  A long one is first compared with one
item of its own, its pivot, which is linear and connects most of a group of copies.
Items that ended up under one label need no comparison among themselves; the rest is
compared with the rest and with all others, dealt out as pairs of blocks.  Lists that
hold mostly the same items, as those of a group of near copies, are first made one list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelake.llm.common import map_arrow, map_groups, run_arrow, settle
from measurelake.llm.components import components

SHORT = 6  # items of a list whose pairs are all passed on
BLOCK = 4096  # items of one side of a pair of blocks, told apart by sketches
WHOLE, WHOLE_BYTES = 768, 1 << 24  # a group compared in one task: its members, the size of its sets
SET_BLOCK, SET_BYTES = 256, 1 << 23  # one side of a pair of blocks of sets
ROW = 64  # comparisons of sketches that cost as much as dealing out one row
ROUNDS = 8  # pivots of a large group at most; what they leave is dealt out in blocks


class Sketches:
    """A kind of sketch: says which items may be linked, strictly or in a relaxed sense."""

    def compared(self, data: list[bytes], sizes: np.ndarray) -> Callable[[int], np.ndarray]:
        """A function that tells which of these items are strictly near one of them."""
        raise NotImplementedError

    def pairs(self, a: list[bytes], b: list[bytes], sizes: np.ndarray, relaxed: np.ndarray) -> np.ndarray:
        """Which pairs are near; ``sizes`` has the sum of both sizes."""
        raise NotImplementedError


def candidate_groups(lists: DataFrame, payload: DataFrame, kind: Sketches, percent: int) -> DataFrame:
    """(node, component) of items such that all strictly near ones share a component.

    ``lists`` is settled, (key..., item, size) with key columns of type long that begin
    with ``k``; only items of sizes within ``percent`` % of each other can be near.
    ``payload`` is settled, (item, size, data), one row an item.  Items are compared that
    share a key; components may hold others, as an item is also joined to a pivot that
    it is near in the relaxed sense.
    """
    keys = [c for c in lists.columns if c.startswith("k")]
    counts = lists.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settle(lists.join(counts, keys), "shared")
    rows = shared.count()

    pairs = _sorted(shared, keys, lambda b: _list_pairs(b, keys, percent), "a long, b long, star boolean")
    pairs = settle(pairs.groupBy("a", "b").agg(F.max("star").alias("star")), "pairs", SHORT * rows // 2)
    near = settle(_near_pairs(pairs, payload, kind), "near")

    long_ = shared.where(F.col("n") > SHORT)
    labels = settle(components(near), "labels", rows)
    named = settle(long_.join(labels, F.col("item") == F.col("node"), "left").select(
        *keys, "item", F.coalesce("component", "item").alias("label")), "named", rows)
    rest = settle(_rest_edges(*_merged_lists(named, keys, rows), rows, payload, kind), "rest")
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest))


def _labels(edges: DataFrame) -> DataFrame:
    """(node, component): a label that only connected nodes share, the same for most that are.

    The least neighbour's least neighbour, in a fixed number of steps.  Nodes that are
    connected and labelled apart are compared once more than needed, no less.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "near")
    least = settle(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least")), "least")
    onward = least.withColumnsRenamed({"node": "_node", "least": "component"})
    return least.join(onward, F.col("least") == F.col("_node")).select("node", "component")


def _sorted(df: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    order = [*keys, "size", "item"]
    return run_arrow(df.repartition(*keys).sortWithinPartitions(*order), run, schema)


def _list_pairs(batches: Iterator[pa.RecordBatch], keys: list[str], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of short lists, and pairs with the pivot in long ones, from rows in order of their lists.

    A list is cut into runs of sizes in which all can be near its first item, the pivot.
    Of a list nothing is held but its pivot, or up to ``SHORT`` items.
    """
    held: list[tuple[int, int]] = []
    key: tuple = ()
    pivot = (0, 0)
    out: list[tuple[int, int, bool]] = []
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rest = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("item", "size", "n")]
        for here, item, size, n in zip(zip(*columns, strict=True), *rest, strict=True):
            if here != key:
                key, held, pivot = here, [], (item, size)
            if n <= SHORT:
                out += [(o, item, False) if o < item else (item, o, False)
                        for o, s in held if 100 * s >= percent * size and o != item]
                held.append((item, size))
            elif 100 * pivot[1] < percent * size:
                pivot = (item, size)
            elif pivot[0] != item:
                out.append((min(pivot[0], item), max(pivot[0], item), True))
        if len(out) > 100_000:
            yield _pairs(out)
            out = []
    if out:
        yield _pairs(out)


def _pairs(out: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    a, b, star = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(star, pa.bool_())], ["a", "b", "star"])


def _near_pairs(pairs: DataFrame, payload: DataFrame, kind: Sketches) -> DataFrame:
    """Pairs (a, b) that are near: strictly, or in the relaxed sense if one was a pivot."""
    def given(side: str) -> DataFrame:
        return payload.select(F.col("item").alias(f"_{side}"), F.col("size").alias(f"size_{side}"),
                              F.col("data").alias(f"data_{side}"))

    both = (pairs.join(given("a"), F.col("a") == F.col("_a")).join(given("b"), F.col("b") == F.col("_b"))
            .drop("_a", "_b"))

    def judge(rows: pa.Table) -> pa.Table:
        a, b, size_a, size_b = (rows.column(c) for c in ("data_a", "data_b", "size_a", "size_b"))
        keep = kind.pairs(a.to_pylist(), b.to_pylist(), size_a.to_numpy() + size_b.to_numpy(),
                          rows.column("star").to_numpy(zero_copy_only=False))
        return rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, judge, "a long, b long")


def dealt(
    members: DataFrame, keys: list[str], blocks: Callable[[Column, Column], Column], rows: int | None = None
) -> DataFrame:
    """Copies of the rows of each list for the pairs of blocks in which unlike labels meet.

    ``members`` has ``item``, ``label`` and ``weight``.  The rows of a list's most
    frequent label stand in blocks of their own, which meet the blocks of the rest only.
    ``blocks`` gives a number of blocks for a number and weight of rows.  Adds
    ``block_a`` <= ``block_b`` and ``block_own``.
    """
    sizes = members.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("weight").cast("double").alias("_w"))
    lists = sizes.groupBy(*keys).agg(
        F.sum("_n").alias("_all_n"), F.sum("_w").alias("_all_w"),
        F.max(F.struct("_n", "_w", "label")).alias("_main"), F.count(F.lit(1)).alias("_labels"),
    ).where("_labels > 1").select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_main.label").alias("_main"),
        blocks(F.col("_all_n") - F.col("_main._n"), F.col("_all_w") - F.col("_main._w")).alias("_rest_blocks"),
        blocks(F.col("_main._n"), F.col("_main._w")).alias("_main_blocks"),
    )
    lists = settle(lists, "lists", rows)
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_{k}") for k in keys])
    out = members.join(lists, same).drop(*[f"_{k}" for k in keys])
    main, hashed = F.col("label") == F.col("_main"), F.xxhash64("item")
    own = F.when(main, F.col("_rest_blocks") + F.pmod(hashed, "_main_blocks")).otherwise(F.pmod(hashed, "_rest_blocks"))
    last = F.when(main, F.col("_rest_blocks")).otherwise(F.col("_rest_blocks") + F.col("_main_blocks")) - 1
    out = out.withColumn("block_own", own).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return out.withColumns({
        "block_a": F.least("block_own", "_other"), "block_b": F.greatest("block_own", "_other"),
    }).drop("_other", "_main", "_rest_blocks", "_main_blocks")


def _work(n: Column, main: Column) -> Column:
    """What it costs to compare a list of ``n`` items, ``main`` of them of one label: rows dealt out, and comparisons."""
    rest = n - main
    rest_blocks, main_blocks = (F.ceil(x / F.lit(BLOCK)) for x in (rest, main))
    rows = main * rest_blocks + rest * (rest_blocks + main_blocks)
    return (F.lit(ROW) * rows + rest * n).cast("double")


def _merged_lists(named: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, list[str]]:
    """(rows of lists with unlike labels, their keys), lists of one main label made one where that costs less.

    The items of a group of near copies stand in many lists together.  An item of another label
    that is in several of these lists would be compared with the same items in each.  A
    merged list holds all items of its lists, so whoever shared a list still does.
    """
    sizes = named.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"))
    mixed = sizes.groupBy(*keys).agg(
        F.sum("_n").alias("_all"), F.max(F.struct("_n", "label")).alias("_main"), F.count(F.lit(1)).alias("_labels"),
    ).where("_labels > 1").select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_main.label").alias("of"),
        _work(F.col("_all"), F.col("_main._n")).alias("_work"))
    mixed = settle(mixed, "mixed", rows)
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_{k}") for k in keys])
    listed = settle(named.join(mixed, same).select(*keys, "item", "label", "of"), "rows", rows)
    apart = mixed.groupBy(F.col("of").alias("_of")).agg(F.sum("_work").alias("_apart"))
    whole = listed.select("of", "item", "label").distinct().groupBy("of").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("label") == F.col("of")).alias("_n"))
    merged = settle(
        whole.join(apart, F.col("of") == F.col("_of")).where(_work(F.col("_all"), F.col("_n")) < F.col("_apart"))
        .select("_of"), "merged", rows)
    told = listed.join(merged, F.col("of") == F.col("_of"), "left")
    one = F.col("_of").isNotNull()
    told = told.select(
        *[F.when(~one, F.col(k)).otherwise(F.lit(0)).cast("long").alias(k) for k in keys],
        F.when(one, F.col("of")).otherwise(F.lit(0)).cast("long").alias("of"), one.cast("long").alias("one"),
        "item", "label")
    return settle(told.distinct(), "members", rows), [*keys, "of", "one"]


def _rest_edges(named: DataFrame, keys: list[str], rows: int, payload: DataFrame, kind: Sketches) -> DataFrame:
    """Edges between items of unlike labels that are strictly near, enough to connect them."""
    deal = dealt(named.withColumn("weight", F.lit(0)), keys, lambda n, w: F.ceil(n / F.lit(BLOCK)).cast("long"), rows)
    dealt_rows = deal.join(payload.select(F.col("item").alias("_item"), "size", "data"), F.col("item") == F.col("_item"))
    by = [*keys, "block_a", "block_b"]
    return map_groups(
        dealt_rows.select(*by, "block_own", "item", "label", "size", "data"), by,
        lambda table, starts: _rest_of(table, starts, kind), "a long, b long", ["size"],
    ).distinct()


def _rest_of(rows: pa.Table, starts: np.ndarray, kind: Sketches) -> pa.Table:
    item, label, own = (rows.column(c).to_numpy() for c in ("item", "label", "block_own"))
    first, size = rows.column("block_a").to_numpy(), rows.column("size").to_numpy()
    data = rows.column("data")
    edges: list[tuple[int, int]] = []
    for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        part = slice(at, end)
        near = kind.compared(data.slice(at, end - at).to_pylist(), size[part])
        edges += _joined(near, item[part], label[part], own[part], first[at])
    return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()),
                     "b": pa.array([b for _, b in edges], pa.int64())})


def _joined(
    near: Callable[[int], np.ndarray], item: np.ndarray, label: np.ndarray, own: np.ndarray, first: int
) -> list[tuple[int, int]]:
    """Edges that connect labels of near items; rows of block ``first`` are compared with all,
    in the other block if there is one."""
    label = label.copy()
    edges = []
    two = own.min() != own.max()
    for i in np.flatnonzero(own == first).tolist():
        unlike = label != label[i]
        if two:
            unlike &= own != first
        if not unlike.any():
            continue
        found = np.flatnonzero(near(i) & unlike)
        while len(found):
            j = int(found[0])
            edges.append((int(item[i]), int(item[j])))
            label[label == label[j]] = label[i]
            found = found[label[found] != label[i]]
    return edges


# -- whole sets ----------------------------------------------------------------


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def exact_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect what whole sets link within each group, and nothing else.

    ``groups`` is (node, component); ``sets`` is settled, (item, size, data): sorted 64-bit hashes.
    """
    held = sets.join(groups, F.col("item") == F.col("node")).select(
        F.col("component").alias("group"), "item", "size", "data")
    held = settle(held, "held")
    sizes = settle(held.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("size") * 8).alias("bytes")).where("n > 1"), "sizes", held.count())
    small = (F.col("n") <= WHOLE) & (F.col("bytes") <= WHOLE_BYTES)

    def of(chosen: Column) -> DataFrame:
        return held.join(sizes.where(chosen).select(F.col("group").alias("_group")), F.col("group") == F.col("_group")).drop("_group")

    one = of(small).withColumns({"label": F.col("item"), "block_own": F.lit(0), "block_a": F.lit(0)})
    edges = map_groups(
        one.select("group", "block_a", "block_own", "item", "label", "size", "data"), ["group"],
        lambda rows, starts: _set_edges(rows, starts, percent), "a long, b long")
    edges = settle(edges, "edges")
    if sizes.where(~small).isEmpty():
        return edges
    return edges.union(_large(settle(of(~small), "large"), percent))


def _large(held: DataFrame, percent: int) -> DataFrame:
    """The same for groups that are too large to be compared whole."""
    edges: list[DataFrame] = []
    rest = held.select("group", "item")
    left = rest.count()
    for _ in range(ROUNDS):
        pivots = settle(
            rest.groupBy("group").agg(F.min("item").alias("pivot"))
            .join(held.select("item", F.col("size").alias("pivot_size"), F.col("data").alias("pivot_data")),
                  F.col("pivot") == F.col("item")).drop("item")
            .withColumnRenamed("group", "_group"), "pivots")
        met = held.join(pivots, (F.col("group") == F.col("_group")) & (F.col("item") != F.col("pivot"))
                        & (100 * F.least("size", "pivot_size") >= percent * F.greatest("size", "pivot_size")))

        def judge(rows: pa.Table) -> pa.Table:
            keep = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)
                    for a, b in zip(rows.column("data").to_pylist(), rows.column("pivot_data").to_pylist(), strict=True)]
            return pa.table({"a": rows.column("pivot"), "b": rows.column("item")}).filter(pa.array(keep, pa.bool_()))

        edges.append(settle(map_arrow(met.select("item", "data", "pivot", "pivot_data"), judge, "a long, b long"), "pivot_edges"))
        gone = edges[-1].select(F.col("b").alias("_b")).union(pivots.select("pivot"))
        rest = settle(rest.join(gone, F.col("item") == F.col("_b"), "left_anti"), "rest")
        before, left = left, rest.count()
        if not left or left > 0.8 * before:
            break
    found = reduce(DataFrame.union, edges)
    labels = settle(_labels(found), "labels")
    named = held.join(labels, F.col("item") == F.col("node"), "left").select(
        "group", "item", F.coalesce("component", "item").alias("label"), F.col("size").alias("weight"))
    deal = dealt(named, ["group"], lambda n, w: F.ceil(F.greatest(
        n / F.lit(SET_BLOCK), w * 8 / F.lit(SET_BYTES))).cast("long"))
    by = ["group", "block_a", "block_b"]
    rows = deal.join(held.select(F.col("item").alias("_item"), "size", "data"), F.col("item") == F.col("_item"))
    more = map_groups(
        rows.select(*by, "block_own", "item", "label", "size", "data"), by,
        lambda table, starts: _set_edges(table, starts, percent), "a long, b long")
    return found.union(more)


def _set_edges(rows: pa.Table, starts: np.ndarray, percent: int) -> pa.Table:
    item, label, own = (rows.column(c).to_numpy() for c in ("item", "label", "block_own"))
    first = rows.column("block_a").to_numpy()
    data = rows.column("data")
    edges: list[tuple[int, int]] = []
    for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        sets = [np.frombuffer(x, np.uint64) for x in data.slice(at, end - at).to_pylist()]
        part = slice(at, end)
        if len(sets) <= 6:  # for few sets, one by one is quicker
            def near(i: int) -> np.ndarray:
                return np.array([similar(sets[i], s, percent) for s in sets])
        else:
            near = _similar_matrix(sets, percent).__getitem__
        edges += _joined(near, item[part], label[part], own[part], first[at])
    return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()),
                     "b": pa.array([b for _, b in edges], pa.int64())})


def _similar_matrix(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets are similar: intersections by products of membership matrices."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = often[place] > 1  # an element of one set is in no intersection
    column = (np.cumsum(often > 1) - 1)[place[keep]]
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (first, first + width))
        member = np.zeros((len(sets), width), np.float32)
        member[owner[lo:hi], column[lo:hi] - first] = 1
        both += member @ member.T
    union = sizes[:, None] + sizes[None] - both
    linked = (100 * both >= percent * union) & (sizes[:, None] > 0) & (sizes[None] > 0)
    np.fill_diagonal(linked, False)
    return linked
