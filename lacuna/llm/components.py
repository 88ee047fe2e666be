"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``: every linked node with the smallest node it reaches.

    Each round every node hands its larger neighbours to its smallest one (large star), then its
    smaller ones (small star). Links only ever move to smaller ends, so the number of rows never
    grows past the links given, and paths halve: the rounds are about the logarithm of the longest
    path. Minima are pre-aggregated, and the join on a hub's key is one that AQE splits. Each
    round is written to the shared folder. Links from a node to itself and null ends are ignored;
    no links give no rows.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        to_least = [F.struct(F.col(end).alias("u"), F.col("m").alias("v")) for end in ("u", "v")]
        small = large.join(low, "u").select(F.inline(F.array(*to_least))).where("u <> v")
        edges = stage(small.distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    root = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
