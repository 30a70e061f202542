"""Merkle manifest of a table: hash trees of three children, in van Emde Boas blocks.

Every row is a leaf; the leaves of a group, in order, make a tree, and the groups'
roots make one more.  A tree is stored in aligned blocks of 3**6 leaves.  The roots
of a layer's blocks are the leaves of the next layer, until one block is left.
Within a block the nodes lie in van Emde Boas order: the upper half of the levels
first, then each subtree below it, each again split at half its height.  The place of
a node follows from its depth and number alone (:func:`address`), in building a block
as in finding siblings, and a path up the tree touches few distinct pieces of memory.

Rows are ranked by a range shuffle and counts of its partitions, so neither a large
group nor many equal rows have to fit one task; a task holds one block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from measurelake.llm.common import map_arrow, map_groups, settle
from measurelake.sources.writers import write_parquet

CHILDREN = 3
HEIGHT = 6  # runs between a block's leaves and its root
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_BLOCK = "tree long, block long, total long, n int, height int, root binary, nodes binary"


def tree_size(levels: int) -> int:
    """Nodes of a complete tree."""
    return (CHILDREN**levels - 1) // (CHILDREN - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Place of the nodes ``index`` of a depth (the root's is 0) of a tree of ``levels`` levels."""
    at = np.zeros_like(index)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, levels = depth - top, levels - top
        subtree, index = np.divmod(index, CHILDREN**depth)
        at = at + tree_size(top) + subtree * tree_size(levels)
    return at


def _joined(digests: list[bytes]) -> bytes:
    return sha256(b"".join(digests).hex().encode()).digest()


def _width(leaves: int, above: int) -> int:
    """Nodes that lie ``above`` runs over a number of leaves."""
    return -(-leaves // CHILDREN**above)


def build_block(leaves: list[bytes], height: int) -> tuple[bytes, bytes]:
    """(root, nodes) of a block; places of nodes that it lacks are zero."""
    nodes = np.zeros((tree_size(height + 1), 32), np.uint8)
    for depth in range(height, -1, -1):
        if depth < height:
            leaves = [_joined(leaves[i : i + CHILDREN]) for i in range(0, len(leaves), CHILDREN)]
        digests = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32)
        nodes[address(depth, np.arange(len(leaves)), height + 1)] = digests
    return leaves[0], nodes.tobytes()


def steps(nodes: bytes, leaf: np.ndarray, n: int, height: int) -> list[list[tuple[int, list[bytes]]]]:
    """For each leaf of a block, from the bottom up: its place in the run, and its siblings."""
    out: list[list[tuple[int, list[bytes]]]] = [[] for _ in leaf]
    for up in range(height):
        depth, index = height - up, leaf // CHILDREN**up
        run = (index - index % CHILDREN)[:, None] + np.arange(CHILDREN)
        there = run < _width(n, up)
        at = (address(depth, run, height + 1) * 32).tolist()
        places = (index % CHILDREN).tolist()
        for path, place, starts, real in zip(out, places, at, there.tolist(), strict=True):
            siblings = [nodes[s : s + 32] for i, s in enumerate(starts) if real[i] and i != place]
            path.append((place, siblings))
    return out


def _packed(path: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join([bytes((place, len(others))) + b"".join(others) for place, others in path])


def _unpacked(path: bytes) -> list[tuple[int, list[bytes]]]:
    out, at = [], 0
    while at < len(path):
        place, count = path[at], path[at + 1]
        at += 2
        out.append((place, [path[i : i + 32] for i in range(at, at + 32 * count, 32)]))
        at += 32 * count
    return out


def fold(leaf: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and the siblings on its path give."""
    for place, others in path:
        leaf = _joined([*others[:place], leaf, *others[place:]])
    return leaf


# -- the tables ----------------------------------------------------------------


@dataclass
class Manifest:
    """Settled tables: the numbered leaves, and the layers of blocks from the bottom up.

    ``leaves`` has the group, ``tree`` (the group's rank), ``rank`` and ``total`` within
    it, ``leaf`` (32 bytes) and the columns kept; ``top`` are the layers over the groups.
    """

    leaves: DataFrame
    layers: list[DataFrame]
    top: list[DataFrame]


def leaf_hash(columns: Sequence[Column]) -> Column:
    """SHA-256, in hexadecimal, of values as byte count, colon and text, or ``-`` for null."""
    parts = []
    for column in columns:
        value = column.cast("string")
        told = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(told, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def build(
    docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "source",
    kept: dict[str, Column] | None = None, height: int = HEIGHT, folder: str | None = None,
) -> Manifest:
    """The manifest of ``docs``, written below ``folder``, by default in the shared folder.

    A leaf is the hash of ``columns``, null being a value of its own.  Groups are
    ordered by their bytes, null first, and form one tree; leaves are ordered by id, null first,
    equal ids by their hash, so that repeated rows are leaves of their own and no
    other order of the input changes a root.  ``kept`` are further columns of each leaf row.
    Empty and very long texts are hashed whole; other columns are ignored, and an
    empty table gives an empty manifest without a root.
    """
    def at(name: str) -> str | None:
        return f"{folder.rstrip('/')}/{name}" if folder else None

    hashed = F.unhex(leaf_hash([F.col(c) for c in columns]))
    rows = _written(docs.select(
        F.col(group_col).alias("group"), F.col(id_col).alias("id"), hashed.alias("leaf"),
        F.monotonically_increasing_id().alias("_key"),  # tells equal rows apart
        *[c.alias(name) for name, c in (kept or {}).items()],
    ), "rows")
    ranked = numbered(rows, ["group"], ["id", "leaf", "_key"])
    groups = ranked.where("rank = 0").select("group")
    trees = _written(numbered(groups, [], ["group"]).select(
        F.col("group").alias("_group"), F.col("rank").alias("tree")), "trees")
    leaves = _written(
        ranked.join(trees, F.col("group").eqNullSafe(F.col("_group"))).drop("_group", "_key"),
        "leaves", at("leaves"))
    layers = _layers(leaves.select("tree", "rank", "total", F.col("leaf").alias("digest")), height, at("layer"))
    total = trees.count()
    top = _layers(
        _roots(layers).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"),
                              F.lit(total).cast("long").alias("total"), F.col("root").alias("digest")),
        height, at("top"))
    return Manifest(leaves, layers, top)


def read(spark: SparkSession, folder: str) -> Manifest:
    """A manifest from the folder that :func:`build` has written."""
    def layers(name: str) -> list[DataFrame]:
        found: list[DataFrame] = []
        while True:
            try:
                found.append(spark.read.parquet(f"{folder.rstrip('/')}/{name}{len(found)}"))
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND" or not found:
                    raise
                return found

    return Manifest(spark.read.parquet(f"{folder.rstrip('/')}/leaves"), layers("layer"), layers("top"))


def _written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    if path is None:
        return settle(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(write_parquet(df, path))


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``rank``, from 0, of each row in its group by ``order``, and the group's ``total``.

    Rows are dealt by range and numbered within partitions, in a settled table; the
    counts of each partition's part of a group tell where its ranks begin.  ``order``
    should tell rows apart: only then can a group be cut anywhere.
    """
    keys = [*group, *order]
    rows = settle(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()), "sorted",
    ).withColumn("_part", F.shiftright("_at", 33))
    named = [F.col(c).alias(f"_of_{c}") for c in group]
    within = Window.partitionBy(*[f"_of_{c}" for c in group])
    parts = rows.groupBy(*named, F.col("_part").alias("_number")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    parts = settle(parts.select(
        *[f"_of_{c}" for c in group], "_number", "_first",
        (F.sum("_n").over(within.orderBy("_number")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(within).alias("total"),
    ), "parts")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    joined = rows.join(parts, reduce(and_, same, F.col("_part") == F.col("_number")))
    rank = F.col("_at") - F.col("_first") + F.col("_before")
    return joined.select(*df.columns, rank.alias("rank"), "total")


def _layers(leaves: DataFrame, height: int, path: str | None) -> list[DataFrame]:
    """Layers of blocks, from the bottom up, over (tree, rank, total, digest)."""
    span, layers = CHILDREN**height, []
    while True:
        block = F.floor(F.col("rank") / F.lit(span)).cast("long")
        dealt = leaves.select("tree", block.alias("block"), "rank", "total", "digest")
        layer = map_groups(dealt, ["tree", "block"], lambda r, s: _blocks(r, s, height), _BLOCK, ["rank"])
        layers.append(_written(layer, "layer", f"{path}{len(layers)}" if path else None))
        more = layers[-1].where(F.col("total") > span)
        if more.isEmpty():
            return layers
        leaves = more.select("tree", F.col("block").alias("rank"),
                             F.ceil(F.col("total") / F.lit(span)).cast("long").alias("total"),
                             F.col("root").alias("digest"))


def _blocks(rows: pa.Table, starts: np.ndarray, height: int) -> pa.Table:
    digests, totals = rows.column("digest").to_pylist(), rows.column("total").to_numpy()
    first = starts[:-1]
    out = []
    for at, end in zip(first.tolist(), starts[1:].tolist(), strict=True):
        runs = height
        if totals[at] <= CHILDREN**height:  # the only block: the tree ends with its first single node
            runs = next(h for h in range(height + 1) if CHILDREN**h >= end - at)
        out.append((end - at, runs, *build_block(digests[at:end], runs)))
    n, runs, root, nodes = zip(*out, strict=True)
    return pa.table({
        **{c: rows.column(c).take(pa.array(first)) for c in ("tree", "block", "total")},
        "n": pa.array(n, pa.int32()), "height": pa.array(runs, pa.int32()),
        "root": pa.array(root, pa.binary()), "nodes": pa.array(nodes, pa.binary()),
    })


def _is_top() -> Column:
    """Whether a block is the only one of its tree in its layer, and so has the tree's root."""
    return F.col("total") <= F.lit(CHILDREN) ** F.col("height")


def _roots(layers: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    tops = [layer.where(_is_top()).select("tree", "root") for layer in layers]
    return reduce(DataFrame.union, tops)


def _headers(layers: list[DataFrame], base: DataFrame) -> DataFrame:
    """The blocks of the lowest layer with the ``path`` from their root upwards.

    ``base`` has the path from the root of each tree upwards: (tree, path).  Works
    down from the top: a block's leaves are the roots of the blocks below.
    """
    base = base.withColumnRenamed("tree", "_tree")
    paths: DataFrame | None = None
    for layer in reversed(layers):
        top = layer.where(_is_top()).join(base, F.col("tree") == F.col("_tree")).drop("_tree")
        if paths is not None:
            rest = layer.where(~_is_top()).join(
                paths, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_block")))
            top = top.union(rest.drop("_tree", "_block"))
        if layer is layers[0]:
            return top
        paths = settle(_leaf_paths(top), "paths").withColumnsRenamed({"tree": "_tree", "rank": "_block"})
    raise ValueError("no layers")


def _leaf_paths(headers: DataFrame) -> DataFrame:
    """(tree, rank, path) of the leaves of blocks with the path above them."""
    def run(rows: pa.Table) -> pa.Table:
        trees, ranks, paths = [], [], []
        for row in rows.to_pylist():
            n, width = row["n"], CHILDREN ** row["height"]
            for i, path in enumerate(steps(row["nodes"], np.arange(n), n, row["height"])):
                trees.append(row["tree"])
                ranks.append(row["block"] * width + i)
                paths.append(_packed(path) + row["path"])
        return pa.table({"tree": pa.array(trees, pa.int64()), "rank": pa.array(ranks, pa.int64()),
                         "path": pa.array(paths, pa.binary())})

    return map_arrow(headers.select("tree", "block", "n", "height", "nodes", "path"), run,
                     "tree long, rank long, path binary")


def proofs(manifest: Manifest, claim: str = "leaf") -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of each leaf, in hexadecimal.

    The proof are the siblings on the way from the leaf to the root, whose joined
    digests are hashed; ``folded_root`` is what they give with the leaf in the column
    ``claim`` (``leaf`` itself where that is null), and ``verified`` whether it is the root.
    A block with its leaves is a task's unit: one header row, then its leaves.
    """
    root = manifest.top[-1].select(F.col("root").alias("top_root"))  # one row, none without leaves
    start = root.sparkSession.range(1).select(F.col("id").alias("tree"), F.lit(b"").alias("path"))
    above = _leaf_paths(_headers(manifest.top, start))
    base = settle(above.select(F.col("rank").alias("tree"), "path"), "group_paths")
    subroots = _roots(manifest.layers).withColumnsRenamed({"tree": "_of", "root": "subroot"})
    lowest = manifest.layers[0]
    headers = (_headers(manifest.layers, base).join(subroots, F.col("tree") == F.col("_of"))
               .crossJoin(F.broadcast(root)))
    id_type = manifest.leaves.schema["id"].dataType.simpleString()
    none = F.lit(None)
    width = lowest.agg(F.max("height")).first()[0] or 0
    span = F.lit(CHILDREN**width)
    heads = headers.select(
        "tree", "block", F.lit(-1).cast("long").alias("rank"), none.cast(id_type).alias("id"),
        none.cast("binary").alias("leaf"), none.cast("binary").alias("claim"),
        "n", "height", "nodes", "path", "subroot", "top_root")
    leaves = manifest.leaves.select(
        "tree", F.floor(F.col("rank") / span).cast("long").alias("block"), "rank", "id", "leaf",
        F.coalesce(claim, "leaf").alias("claim"), none.cast("int").alias("n"), none.cast("int").alias("height"),
        *[none.cast("binary").alias(c) for c in ("nodes", "path", "subroot", "top_root")])
    return map_groups(
        heads.union(leaves), ["tree", "block"], _prove,
        f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean", ["rank"])


def _prove(rows: pa.Table, starts: np.ndarray) -> pa.Table:
    columns = {c: rows.column(c) for c in ("n", "height", "nodes", "path", "subroot", "top_root")}
    ranks, leaves = rows.column("rank").to_numpy(), rows.column("leaf").to_pylist()
    claims = rows.column("claim").to_pylist()
    out: list[tuple] = []
    for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        head = {name: column[at].as_py() for name, column in columns.items()}
        root, subroot, upper = head["top_root"], head["subroot"].hex(), _unpacked(head["path"])
        more = b"".join([d for _, others in upper for d in others])
        places = ranks[at + 1 : end] % CHILDREN ** head["height"]
        found = steps(head["nodes"], places, head["n"], head["height"])
        for i, path in enumerate(found, at + 1):
            siblings = b"".join([d for _, others in path for d in others]) + more
            folded = fold(fold(claims[i], path), upper)
            out.append((leaves[i].hex(), subroot, root.hex(), sha256(siblings.hex().encode()).hexdigest(),
                        folded.hex(), folded == root))
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    values = list(zip(*out, strict=True)) or [[]] * len(names)
    kinds = [pa.string()] * 5 + [pa.bool_()]
    mask = np.ones(rows.num_rows, bool)
    mask[starts[:-1]] = False
    return pa.table({"id": rows.column("id").filter(pa.array(mask)),
                     **{n: pa.array(v, k) for n, v, k in zip(names, values, kinds, strict=True)}})


def tampered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The leaf of a row whose text has lost its line feeds, where 2 divides the id's CRC-32.

    Null for the other rows, and for a null id.
    """
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    columns = [F.translate(F.col(c), "\n", "") if c == text_col else F.col(c) for c in COLUMNS]
    return F.when(even, F.unhex(leaf_hash(columns)))
