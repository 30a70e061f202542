"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurelake.llm.common import gathered, settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Alternates large-star and small-star steps, which turn every component into
    a star around its smallest node in about log(n) rounds.  Minima are partial
    aggregates, settled before they are joined: both sides of a join are then plain
    shuffles, of which adaptive execution splits the part that has a hub.  Each round is
    written to the shared folder, so a lost executor costs one round.  No step has more
    edges than the one before, so the first count says how many tasks and files a step
    needs.  Null ends and loops are left out.
    """
    links = settle(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where((F.col(a).isNotNull()) & (F.col(b).isNotNull()) & (F.col(a) != F.col(b))).distinct(),
        "edges",
    )
    rows = links.count()
    while rows and not _are_stars(links, rows):
        links = settle(_large_star(links, rows), "large_star", rows)
        links = settle(_small_star(links, rows), "edges", rows)
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return gathered(roots, rows).union(links.select("hi", "lo"))


def _are_stars(links: DataFrame, rows: int) -> bool:
    """Whether each node hangs on one other at most, and on none that hangs itself."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("lo", F.lit(0), F.lit(1)))
    mixed = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return gathered(mixed.where((F.col("up") > 1) | (F.col("up") + F.col("down") > 1)), 2 * rows).isEmpty()


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Hang the larger neighbours of each node on its smallest neighbour, or on itself."""
    least = settle(
        links.select(F.col("hi").alias("node"), "lo")
        .union(links.select("lo", F.col("lo").alias("least")))
        .groupBy("node").agg(F.min("lo").alias("least")), "least", 2 * rows,
    )
    joined = links.join(least, links["lo"] == least["node"])
    return joined.select("hi", F.col("least").alias("lo")).distinct()


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    least = settle(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")), "least", rows)
    joined = links.join(least, links["hi"] == least["node"])
    smaller = joined.where("lo != least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return smaller.union(least.select("node", "least")).distinct()
