import math
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from lacuna.llm import sharding
from lacuna.llm.sharding import Leaf

from llm_support import no_docs, odd, odd_rows  # noqa: F401


def places(spark, tree, n=4_000):
    rows = spark.range(n).select("id", sharding.placed(F.col("id"), tree).alias("shard")).collect()
    return {r.id: r.shard for r in rows}


def test_odd_rows(odd, odd_rows, no_docs):
    tree, grown = sharding.layout(24), sharding.layout(25)
    got = sharding.sharded(odd, tree, grown).collect()
    expected = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in odd_rows]
    assert sorted(map(str, ((r.id, r.size, r.text_crc32) for r in got))) == sorted(map(str, expected))
    by_shard, of_id = {}, {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        of_id.setdefault(r.id, set()).add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in of_id.values())
    assert sharding.sharded(no_docs, tree).count() == 0
    assert {r.grown_shard for r in sharding.sharded(odd, tree).collect()} == {None}


def test_shares_follow_weights(spark):
    found = places(spark, sharding.layout(24))
    counts = [list(found.values()).count(k) for k in range(24)]
    assert min(counts) > 110 and max(counts) < 230
    heavy = [Leaf("a", "x", 0, 3.0), Leaf("a", "y", 1, 1.0), Leaf("b", "x", 2, 4.0), Leaf("b", "x", 3, 0.0)]
    counts = [list(places(spark, heavy).values()).count(k) for k in range(4)]
    assert [abs(c - e) < 150 for c, e in zip(counts, (1_500, 500, 2_000, 0))] == [True] * 4 and counts[3] == 0


@pytest.mark.parametrize("shards", [24, 25, 30])
def test_one_more_shard_only_gains(spark, shards):
    before, after = places(spark, sharding.layout(shards)), places(spark, sharding.layout(shards + 1))
    moved = [after[k] for k in before if after[k] != before[k]]
    assert set(moved) == {shards} and 0.5 < len(moved) * (shards + 1) / len(before) < 1.6


def test_movement_stays_in_the_changed_subtree(spark):
    tree = sharding.layout(24)
    heavier = [Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else x.weight) for x in tree]
    before, after = places(spark, tree), places(spark, heavier)
    rack = {x.shard: x.rack for x in tree}
    region = {x.shard: x.region for x in tree}
    for k in before:
        if before[k] != after[k]:
            # a move between regions ends in the region of shard 5, one between racks in its rack, others in it
            assert region[after[k]] == region[5]
            if region[before[k]] == region[5]:
                assert rack[after[k]] == rack[5]
                if rack[before[k]] == rack[5]:
                    assert after[k] == 5


def test_slots_of_many_rows(spark):
    docs = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    again = docs.unionByName(docs.where("doc_id < 2000"))  # repeated rows
    got = sharding.sharded(again, sharding.layout(3, base=3)).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("d")).collect()
    assert len(got) == 3 and all(r.n == r.d == r.m + 1 for r in got)


def test_no_weight():
    with pytest.raises(ValueError):
        sharding.placed(F.lit(1), [Leaf("a", "b", 0, 0.0)])


def test_fewer_shards_than_the_base_are_refused():
    with pytest.raises(ValueError, match="base"):
        sharding.layout(11)
    assert len(sharding.layout(11, base=11)) == 11


@pytest.mark.parametrize("base", [1, 5, 11, 24])
def test_a_further_shard_only_takes(spark, base):
    """From any base on, one more shard takes rows only into itself."""
    before, after = places(spark, sharding.layout(base, base=base)), places(spark, sharding.layout(base + 1, base=base))
    moved = {k for k in before if before[k] != after[k]}
    assert moved and all(after[k] == base for k in moved)


def test_draws_against_brute_force(spark):
    """Every draw again, in Python: ln(u) / weight of the hash of key and path, level by level."""
    tree = [sharding.Leaf(f"r{k % 2}", f"k{k % 3}", k, 0.5 + k % 4) for k in range(9)]
    seed = 42

    def place(key):
        path, names = "", tree
        for level in sharding.LEVELS:
            weights = {}
            for leaf in names:
                name = str(getattr(leaf, level))
                weights[name] = weights.get(name, 0.0) + leaf.weight
            draws = []
            for name, weight in weights.items():
                u = xxhash.xxh64_intdigest(f"{key}{path}/{name}".encode(), seed) >> 11
                draws.append((math.log((u + 0.5) / 2.0**53) / weight, name))
            _, best = max(draws)
            path, names = f"{path}/{best}", [leaf for leaf in names if str(getattr(leaf, level)) == best]
        return int(path.rpartition("/")[2])

    ids = [*range(500), -7, 2**40]
    rows = spark.createDataFrame([(k,) for k in ids], "k bigint").select("k", sharding.placed(F.col("k"), tree).alias("shard"))
    assert {r.k: r.shard for r in rows.collect()} == {k: place(k) for k in ids}


def test_a_shard_without_weight_moves_only_its_own_rows(spark):
    """Taking the weight of a shard away leaves the draws of its siblings what they were."""
    tree = [Leaf("r", "k", k) for k in range(6)]
    before, after = places(spark, tree), places(spark, [Leaf("r", "k", k, 0.0 if k == 1 else 1.0) for k in range(6)])
    assert {before[k] for k in before if before[k] != after[k]} == {1}
    assert 1 not in after.values()
