"""Sharding by a hierarchical weighted hash tree.

A row goes down from the root: at each node every child draws ``ln(u) / weight`` with a hash ``u`` of
the row's key and the child's path, and the largest draw wins. A child is chosen in proportion to its
weight, and a changed weight moves rows only into or out of the subtree it belongs to: the draws of
all other children stay what they were.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import least_id

LEVELS = ("region", "rack", "shard")
#: Rows of a shard are numbered in so many parts, each on its own.
PARTS = 4_096


@dataclass(frozen=True)
class Leaf:
    """A shard and where it stands."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, base: int = 24, per_rack: int = 4, racks: int = 3) -> list[Leaf]:
    """The tree that a number of shards stands for.

    The first ``base`` shards fill racks and regions. Each further shard is a region of its own until
    a new layout is chosen: so what it draws, it draws from the whole tree, and no other shard gains.
    That holds from ``base`` on; fewer shards are another tree, with a base of their own, so they are
    refused here.
    """
    if shards < base:
        raise ValueError(f"{shards} shards are fewer than the base of {base}: choose the base with the layout")
    tree = []
    for k in range(shards):
        rack, region = k // per_rack, k // (per_rack * racks)
        tree.append(Leaf(f"r{region}", f"k{rack}", k) if k < base else Leaf(f"new{k}", "k", k))
    return tree


def _children(tree: list[Leaf]) -> Column:
    """A literal map: the path of each inner node to its children and their weights."""
    weights: dict[str, dict[str, float]] = {}
    for leaf in tree:
        path = ""
        for name in (leaf.region, leaf.rack, str(leaf.shard)):
            node = weights.setdefault(path, {})
            node[name] = node.get(name, 0.0) + leaf.weight
            path = f"{path}/{name}"
    pairs = []
    for path, node in weights.items():
        rows = [F.struct(F.lit(name).alias("name"), F.lit(w).alias("weight")) for name, w in node.items() if w > 0]
        pairs += [F.lit(path), F.array(*rows)]
    return F.create_map(*pairs)


def _draw(text: Column, path: Column) -> Callable[[Column], Column]:
    """The draw of a child below ``path`` (a function of one argument: with two, Spark passes an index)."""

    def draw(child: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.concat(text, path, F.lit("/"), child["name"])), 11)
        return F.struct((F.ln((u + 0.5) / float(1 << 53)) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return draw


def placed(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key: ``key`` and the tree decide, nothing else. A null key counts as empty."""
    if not any(leaf.weight > 0 for leaf in tree):
        raise ValueError("no shard has a weight")
    children, text = _children(tree), F.coalesce(key.cast("string"), F.lit(""))
    path = F.lit("")
    for _ in LEVELS:
        best = F.array_max(F.transform(F.try_element_at(children, path), _draw(text, path)))
        path = F.concat(path, F.lit("/"), best["name"])
    return F.element_at(F.split(path, "/"), -1).cast("int")


def sharded(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: ``id, size, text_crc32, shard, grown_shard, slot``.

    ``size`` is the UTF-8 bytes of the text and 8 more, ``grown_shard`` the place under ``grown``
    (null without one), ``slot`` the row's number in its shard, from 0 without gaps. A null text has
    no bytes and checksum 0; null ids share one key; repeated rows go to one shard, under slots of
    their own. An empty table gives no rows.

    Rows are numbered inside ``PARTS`` hash parts of each shard; where a part begins comes from the
    counts of the parts before it, at most ``PARTS`` numbers per shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        placed(F.col(id_col), tree).alias("shard"),
        (F.lit(None).cast("int") if grown is None else placed(F.col(id_col), grown)).alias("grown_shard"),
    ).withColumn("part", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(PARTS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy(*least_id("id"), "text_crc32", "size")
    numbered = rows.withColumn("within", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "part"]).select(
        "id", "size", "text_crc32", "shard", "grown_shard", (F.col("start") + F.col("within")).alias("slot")
    )
