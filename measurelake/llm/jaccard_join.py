"""Documents linked by the Jaccard similarity of their word n-grams, by a size-aware join.

Sets are joined in two ways, by size.

Light sets enumerate subsets.  Two sets of sizes n and m are linked if they share c
elements, c following from n, m and the least similarity.  For each size that can be
linked with its own a light set lists its subsets of exactly c elements; two light sets
are linked if and only if they list the same one.  At 90 % few elements can be missing, so
few subsets are listed; their number grows fast with the size, though.

Heavy sets scan inverted lists.  Elements are ordered by how often they occur, rare
ones first, and linked sets share one of the first n - ceil(0.9 n) + 1 elements of each.
The lists of these elements give candidates.  Parity sketches, from which follows a
lower bound of the symmetric difference, rule most of them out, and whole sets decide.

The boundary is the size at which both ways together list least, by the sizes of the
sets at hand and the mean length of a list.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurelake.llm.common import map_arrow, run_arrow, settle
from measurelake.llm.components import components
from measurelake.llm.files import binary
from measurelake.llm.linking import Sketches, candidate_groups, exact_links
from measurelake.llm.marks import mix
from measurelake.llm.near_dedup import bridges, group_sets
from measurelake.llm.shingles import shingle_set

WORDS, PERCENT = 3, 90
MOST_LIGHT = 48  # the boundary lies at or below this size
PIVOT_PERCENT = 80  # similarity, by sketches, at which a set joins the group of a pivot
_CELLS = 1 << 18  # in which occurrences are counted; their order needs no more


def least_shared(n: int, m: int, percent: int) -> int:
    """Elements that linked sets of n and m elements share at least."""
    return -(-percent * (n + m) // (100 + percent))


@cache
def partners(n: int, percent: int) -> list[tuple[int, int]]:
    """(m, elements that a set of n leaves out) of the sizes that n can be linked with.

    Equal sets aside: those are one set here.
    """
    out = []
    for m in range(-(-percent * n // 100), 100 * n // percent + 1):
        shared = least_shared(n, m, percent)
        if shared <= min(n, m) and not (n == m == shared):
            out.append((m, n - shared))
    return out


def prefix(n: int, percent: int) -> int:
    """How many first elements of a set are bound to hold one that a linked set shares."""
    return n - -(-percent * n // 100) + 1


def boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The least size of a heavy set: where subsets below and lists from there on cost least.

    ``sizes`` has the number of sets of each size up to :data:`MOST_LIGHT`.  A light set
    costs its subsets, a heavy one the entries of the lists that it scans.
    """
    def subsets(n: int, heavy: int) -> int:
        return sum(math.comb(n, left_out) for m, left_out in partners(n, percent) if m < heavy)

    def scanned(n: int) -> float:
        return prefix(n, percent) * list_length

    costs = [sum(k * (subsets(n, x) if n < x else scanned(n)) for n, k in sizes.items())
             for x in range(1, MOST_LIGHT + 2)]
    return 1 + int(np.argmin(costs))


class Parities(Sketches):
    """Sketches of a bit for each cell of elements, set if it has an odd number of them.

    Bits that differ are no more than the elements of just one of the sets.  There are
    two to four cells an element; a longer sketch is folded for a shorter one.
    """

    def __init__(self, percent: int, pivot_percent: int) -> None:
        self._percent, self._pivot_percent = percent, pivot_percent

    def compared(self, data: list[bytes], sizes: np.ndarray) -> Callable[[int], np.ndarray]:
        widths = np.array([len(d) for d in data])
        places = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
        cells = {w: np.frombuffer(b"".join([data[i] for i in at.tolist()]), np.uint64).reshape(-1, w // 8)
                 for w, at in places.items()}

        def near(i: int) -> np.ndarray:
            out = np.zeros(len(widths), bool)
            own, width = np.frombuffer(data[i], np.uint64), int(widths[i])
            for other, at in places.items():
                if max(other, width) > 2 * min(other, width):
                    continue  # the sizes differ too much for a link
                there, here = cells[other], own
                if other > width:
                    there = there[:, : width // 8] ^ there[:, width // 8 :]
                elif other < width:
                    here = own[: other // 8] ^ own[other // 8 :]
                apart = np.bitwise_count(there ^ here).sum(1, dtype=np.int64)
                out[at] = apart <= _most_apart(sizes[at] + sizes[i], self._percent)
            return out

        return near

    def pairs(self, a: list[bytes], b: list[bytes], sizes: np.ndarray, relaxed: np.ndarray) -> np.ndarray:
        apart = np.array([_apart(x, y) for x, y in zip(a, b, strict=True)], np.int64)
        return apart <= np.where(
            relaxed, _most_apart(sizes, self._pivot_percent), _most_apart(sizes, self._percent))


def _most_apart(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Elements that are in one of two linked sets only, at most, by the sum of their sizes."""
    return sizes - 2 * (-(-percent * sizes // (100 + percent)))


def _apart(a: bytes, b: bytes) -> int:
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "little")
    width = len(a)
    while width > len(b):
        width //= 2
        x = (x >> 8 * width) ^ (x & (1 << 8 * width) - 1)
    return (x ^ int.from_bytes(b, "little")).bit_count()


def parity_sketch(elements: np.ndarray) -> bytes:
    """A bit for each of 2 to 4 cells an element, a power of two and 64 at least."""
    cells = max(64, 1 << (2 * len(elements) - 1).bit_length())
    hit = np.bincount((elements & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((hit & 1).astype(bool), bitorder="little").tobytes()


# -- the join --------------------------------------------------------------------


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_shingles and component_id, one row for each row of ``docs``.

    A document's set are the distinct shingles of ``words`` words of its whole text, A-Z
    counting as a-z; with fewer words, all of them as one.  Documents are linked when
    100 * intersection >= percent * union; ``component_id`` is the smallest id reachable
    over links, the document's own included.

    Null, empty and wordless texts have no shingles and are linked with nothing.  Equal
    sets are collapsed before the join.  Rows with one id are one document: all are linked
    through it.  A row with a null id is linked with nothing and has no component.  Very long
    texts are read whole, other columns are ignored, and an empty table gives an empty result.
    """
    def shingles(text: bytes | None) -> np.ndarray:
        return shingle_set(text, words)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = _order(base, shingles)
    signed = settle(map_arrow(base, lambda rows: _sign(rows, shingles, order.value, percent), _SIGNED), "signed")
    same = ["hi", "lo", "size"]
    reps = settle(signed.where("size > 0 and doc_id is not null").groupBy(*same).agg(
        F.min("doc_id").alias("rep")), "reps")
    one = signed.join(reps.withColumnsRenamed({c: f"_{c}" for c in same}), (F.col("doc_id") == F.col("rep"))
                      & (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")) & (F.col("size") == F.col("_size")))
    one = settle(one.dropDuplicates([*same, "rep"]).select(
        F.col("rep").alias("item"), "size", "firsts", "sketch", "elements"), "distinct")

    lists = settle(map_arrow(one.select("item", "size", "firsts"), _lists, "k long, item long, size long"), "lists")
    light = one.where(F.col("size") <= MOST_LIGHT)
    heavy = _boundary(light, lists, percent)
    links = _subset_edges(light.where(F.col("size") < heavy), heavy, percent)
    partner = F.col("size") * 100 >= heavy * percent  # of a heavy set
    payload = one.where(partner).select("item", "size", F.col("sketch").alias("data"))
    groups = settle(candidate_groups(
        lists.where(partner), payload, Parities(percent, min(percent, PIVOT_PERCENT)), percent), "groups")
    links = links.union(exact_links(groups, group_sets(groups, base, shingles), percent))

    named = signed.select("doc_id", *same).join(reps, same, "left")
    linked = components(links.union(bridges(named)))
    found = named.join(linked, F.col("rep") == F.col("node"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))


def _order(base: DataFrame, shingles: Callable[[bytes | None], np.ndarray]):
    """Broadcast: how often the elements of each cell occur, as steps of a doubling.

    Counts of all texts, 256 KB in all whatever their number.  Elements are taken in
    order of their cell's step and then of their hash, so frequent ones come last.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CELLS, np.int64)
        for batch in batches:
            held, n = [], 0
            for text in binary(pa.Table.from_batches([batch]), "text"):
                held.append(_cell(shingles(text)))
                n += len(held[-1])
                if n > 1_000_000:
                    total += np.bincount(np.concatenate(held), minlength=_CELLS)
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=_CELLS)
        used = np.flatnonzero(total)
        if len(used):
            yield from pa.table({"cell": used, "n": total[used]}).to_batches()

    cells = run_arrow(base.select("text"), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = cells.toArrow()  # at most one row for each cell
    steps = np.zeros(_CELLS, np.uint8)
    steps[found.column("cell").to_numpy()] = np.minimum(8 * np.log2(1 + found.column("n").to_numpy()), 255)
    return base.sparkSession.sparkContext.broadcast(steps)


def _cell(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(46)).astype(np.int64)


_SIGNED = "doc_id long, size long, hi long, lo long, firsts binary, sketch binary, elements binary"


def _sign(rows: pa.Table, shingles: Callable, steps: np.ndarray, percent: int) -> pa.RecordBatch:
    """Size, hash, first elements and sketch of each set; small ones whole."""
    sizes, marks, firsts, sketches, whole = [], [], [], [], []
    for text in binary(rows, "text"):
        elements = shingles(text)
        n = len(elements)
        sizes.append(n)
        marks.append(xxhash.xxh3_128_digest(elements.tobytes()))
        if n:
            often = steps[_cell(elements)]
            k = prefix(n, percent)
            near = elements if k == n else elements[often <= np.partition(often, k - 1)[k - 1]]
            first = np.lexsort((near, steps[_cell(near)]))[:k]
            firsts.append(near[first].tobytes())
        else:
            firsts.append(None)
        sketches.append(parity_sketch(elements) if n else None)
        whole.append(elements.tobytes() if 0 < n <= MOST_LIGHT else None)
    halves = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(halves[:, 0]),
         pa.array(halves[:, 1]), *[pa.array(x, pa.binary()) for x in (firsts, sketches, whole)]],
        [f.split()[0] for f in _SIGNED.split(", ")])


def _boundary(light: DataFrame, lists: DataFrame, percent: int) -> int:
    """The least size of a heavy set, from counts by size and the mean length of a list."""
    sizes = {r["size"]: r["n"] for r in light.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    told = lists.agg(F.count(F.lit(1)).alias("entries"), F.approx_count_distinct("k", 0.02).alias("lists")).first()
    return boundary(sizes, told["entries"] / max(1, told["lists"]), percent)


def _lists(rows: pa.Table) -> pa.RecordBatch:
    firsts = rows.column("firsts").to_pylist()
    lengths = [len(f) // 8 for f in firsts]
    key = np.frombuffer(b"".join(firsts), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(key), *[pa.array(np.repeat(rows.column(c).to_numpy(), lengths)) for c in ("item", "size")]],
        ["k", "item", "size"])


def _subset_edges(light: DataFrame, heavy: int, percent: int) -> DataFrame:
    """Edges (a, b) between light sets that list the same subset: each with the first to do so."""
    def run(rows: pa.Table) -> pa.Table:
        high, low, items = [], [], []
        for item, data in zip(rows.column("item").to_pylist(), rows.column("elements").to_pylist(), strict=True):
            elements = np.frombuffer(data, np.uint64)
            for m, left_out in partners(len(elements), percent):
                if m >= heavy:
                    continue  # met in the lists
                one, two = subset_keys(elements, m, left_out)
                high.append(one)
                low.append(two)
                items.append(np.full(len(one), item))
        if not items:
            return pa.table({c: pa.array([], pa.int64()) for c in ("high", "low", "item")})
        return pa.table({"high": np.concatenate(high).view(np.int64), "low": np.concatenate(low).view(np.int64),
                         "item": np.concatenate(items)})

    keys = map_arrow(light.select("item", "elements"), run, "high long, low long, item long")
    shared = settle(keys, "subsets")
    first = settle(shared.groupBy("high", "low").agg(F.min("item").alias("a"), F.max("item").alias("z"))
                   .where("a < z").select(F.col("high").alias("_high"), F.col("low").alias("_low"), "a"), "first")
    met = shared.join(first, (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")))
    return settle(met.where("a <> item").select("a", F.col("item").alias("b")).distinct(), "subset_edges")


@cache
def _left_out(n: int, count: int) -> np.ndarray:
    return np.array(list(combinations(range(n), count)), np.int64).reshape(math.comb(n, count), count)


def subset_keys(elements: np.ndarray, other: int, left_out: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of the subsets that leave out so many elements, for partners of a size."""
    n = len(elements)
    sizes = np.uint64(min(n, other) << 32 | max(n, other))
    out = _left_out(n, left_out)
    keys = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        marks = mix(elements ^ np.uint64(seed))
        keys.append(mix(marks.sum() - marks[out].sum(1, dtype=np.uint64) + sizes))
    return keys[0], keys[1]
