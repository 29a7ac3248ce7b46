"""Connected components over an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups


def _star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (u, v, m): each edge from u with the smallest of u's neighbours and u itself. Minima are taken before the shuffle too; hot u are joined by broadcast."""
    lows = scratch.table(edges.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("degree")), f"{name}-lows")
    total = int(lows.agg(F.sum("degree")).first()[0] or 0)
    return join_groups(edges, lows, ["u"], "degree", total).select("u", "v", F.least("low", "u").alias("m"))


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node that has an edge (a, b); the root is the smallest node of its component.

    Edges may repeat, run either way or loop. Each step is written, and no edge,
    node or component reaches the driver; the steps end when a step changes
    nothing, after a number of rounds that grows with the logarithm of the nodes.
    """
    small = _contracted(edges, scratch, name, None)
    return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def contracted(edges: DataFrame, scratch: Scratch, name: str, rounds: int) -> DataFrame:
    """Edges (a, b), a greater than b, of the same components after some rounds: most nodes have one, to the smallest of their component or near it."""
    return _contracted(edges, scratch, name, rounds).select(F.col("u").alias("a"), F.col("v").alias("b"))


def _contracted(edges: DataFrame, scratch: Scratch, name: str, rounds: int | None) -> DataFrame:
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = scratch.table(pairs, f"{name}-0")
    mark = _mark(pairs) if rounds is None else ()
    step = 0
    while True:
        step += 1
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, scratch, f"{name}-{step}l").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, f"{name}-{step}l")
        star = _star(large, scratch, f"{name}-{step}s")
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.table(small, f"{name}-{step}s")
        if rounds is None:
            now = _mark(small)
            if now == mark:
                return small
            mark = now
        elif step == rounds:
            return small
        pairs = small


def _mark(pairs: DataFrame) -> tuple:
    """A checksum of an edge set: two equal ones in a row mean that a step changed nothing."""
    row = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
    return tuple(row)
