"""Numbers that describe a frame."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import require

QUARTILES = (0.25, 0.5, 0.75)
#: Bits of a value's key that each scan looks at.
BITS = (22, 21, 21)
#: Keys a task gathers before it folds them.
GATHERED = 1 << 18


def profile(
    df: DataFrame,
    nulls: Sequence[str] = (),
    distinct: Sequence[str] = (),
    flags: Sequence[str] = (),
) -> DataFrame:
    """Row count, null counts, distinct counts (null is a value) and flag counts, in one pass."""
    require(df, *nulls, *distinct, *flags)
    numbers = [F.count("*").alias("rows")]
    numbers += [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in nulls]
    numbers += [
        (F.count_distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("bigint")), F.lit(0))).alias(f"{c}_distinct")
        for c in distinct
    ]
    for c in flags:
        numbers += [F.count_if(F.col(c)).alias(f"{c}_true"), F.count_if(~F.col(c)).alias(f"{c}_false")]
    return df.agg(*numbers)


def summary_stats(
    df: DataFrame,
    cols: Sequence[str],
    probabilities: Sequence[float] = QUARTILES,
    bits: Sequence[int] = BITS,
) -> DataFrame:
    """One row per column: ``count, mean, std, min``, one column per probability, ``max``.

    Quantiles are exact and interpolated between neighbours; nulls are left out, NaN is the largest
    value. A double's bits, read as a whole number, stand in its order. The first scan counts how many
    values share the first bits of that number; running sums tell which of these prefixes hold a wanted
    rank. The next scan looks only at their values, by more bits; after the last scan a prefix is a
    value. Counts merge, so a task sends one row per prefix it met: at most ``2**bits`` for each prefix
    that is looked at (two for a probability), however many rows there are. The scans, one for each
    entry of ``bits``, run at once; what reaches the driver is a few rows.
    """
    if sum(bits) != 64:
        raise ValueError(f"the bits of a double are 64: {bits}")
    require(df, *cols)
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    kinds = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    seen = Observation()
    described = [f(c).alias(f"{name}_{c}") for c in numbers.columns for name, f in kinds.items()]
    scanned = numbers.observe(seen, F.count("*").alias("rows"), *described)

    #: By column and prefix: how many values come before it, and which ranks it holds.
    held: dict[tuple[int, int], tuple[int, list[int] | None]] = {(k, 0): (0, None) for k in range(len(cols))}
    for done, step in zip(accumulate(bits, initial=0), bits):
        hits = _hits(_prefix_counts(numbers if done else scanned, held, done, step), held, step, probabilities)
        held = {(r["c"], r["prefix"]): (r["before"], list(r["ranks"])) for r in hits.collect()}
    found = {(c, rank): _value(key) for (c, key), (_, ranks) in held.items() for rank in ranks or ()}
    # Without a value nothing is held, and of a table known to be empty nothing is observed.
    stats = seen.get if held else {}

    def row(k: int) -> tuple:
        count, mean, std, low, high = (stats.get(f"{name}_c{k}") for name in kinds)
        count = count or 0
        quantiles = []
        for p in probabilities:
            rank = (count - 1) * p
            below, above = found.get((k, floor(rank))), found.get((k, ceil(rank)))
            quantiles.append(None if below is None else below if above == below else below + (above - below) * (rank - floor(rank)))
        return (cols[k], count, mean, std, low, *quantiles, high)

    names = ["mean", "std", "min", *(f"{p * 100:g}%" for p in probabilities), "max"]
    schema = ", ".join(["column string", "count bigint", *(f"`{name}` double" for name in names)])
    return df.sparkSession.createDataFrame([row(k) for k in range(len(cols))], schema)


def _key(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order; both zeros are one, and all NaNs, above all others."""
    bits = (np.where(np.isnan(values), np.nan, values) + 0.0).view(np.int64)
    return bits ^ (bits >> 63 & np.int64(2**63 - 1))


def _value(key: int) -> float:
    """The double of a key: the same step undoes itself."""
    bits = np.int64(key)
    return float((bits ^ (bits >> np.int64(63) & np.int64(2**63 - 1))).view(np.float64))


def _prefix_counts(numbers: DataFrame, held: Mapping[tuple[int, int], object], done: int, step: int) -> DataFrame:
    """``c, prefix, n``: for the values of each column whose first ``done`` bits are a held prefix, how many
    share ``step`` bits more."""
    looked_at = {c: np.array([p for k, p in held if k == c], np.int64) for c, _ in held}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {c: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for c in looked_at}
        waiting: dict[int, list[np.ndarray]] = {c: [] for c in looked_at}
        size = 0

        def fold() -> None:
            for c, parts in waiting.items():
                if parts:
                    prefix, n = np.unique(np.concatenate(parts), return_counts=True)
                    merged, at = np.unique(np.concatenate([counts[c][0], prefix]), return_inverse=True)
                    sums = np.zeros(len(merged), np.int64)
                    np.add.at(sums, at, np.concatenate([counts[c][1], n]))
                    counts[c], waiting[c] = (merged, sums), []

        for batch in batches:
            for c, prefixes in looked_at.items():
                key = _key(batch.column(c).drop_null().to_numpy())
                if done:
                    key = key[np.isin(key >> (64 - done), prefixes)]
                waiting[c].append(key >> (64 - done - step))
                size += len(key)
            if size >= GATHERED:
                fold()
                size = 0
        fold()
        for c, (prefix, n) in counts.items():
            for k in range(0, len(prefix), GATHERED):
                part = slice(k, k + GATHERED)
                columns = [pa.array(np.full(len(prefix[part]), c), pa.int32()), pa.array(prefix[part]), pa.array(n[part])]
                yield pa.RecordBatch.from_arrays(columns, ["c", "prefix", "n"])

    each = numbers.mapInArrow(run, "c int, prefix bigint, n bigint")
    return each.groupBy("c", "prefix").agg(F.sum("n").alias("n"))


def _hits(
    counts: DataFrame,
    held: Mapping[tuple[int, int], tuple[int, list[int] | None]],
    step: int,
    probabilities: Sequence[float],
) -> DataFrame:
    """``c, prefix, before, ranks``: the prefixes that hold a wanted rank. A window sorts the prefixes
    within one of the scan before: at most ``2**step`` rows."""
    given = [(c, p, before, ranks) for (c, p), (before, ranks) in held.items()]
    known = counts.sparkSession.createDataFrame(given, "c int, old bigint, base bigint, wanted array<bigint>")
    first = any(ranks is None for _, ranks in held.values())
    old = F.lit(0).cast("bigint") if first else F.shiftright("prefix", step)
    rows = counts.withColumn("old", old).join(F.broadcast(known), ["c", "old"])  # some ranks of some columns
    group = Window.partitionBy("c", "old")
    rows = rows.withColumn("upto", F.col("base") + F.sum("n").over(group.orderBy("prefix")))
    if first:
        last = F.sum("n").over(group) - 1
        ranks = F.array(*[f(last * F.lit(float(p))).cast("bigint") for p in probabilities for f in (F.floor, F.ceil)])
        rows = rows.withColumn("wanted", F.array_distinct(ranks))
    before = F.col("upto") - F.col("n")
    mine = F.filter("wanted", lambda rank: (rank >= before) & (rank < F.col("upto")))
    return rows.select("c", "prefix", before.alias("before"), mine.alias("ranks")).where(F.size("ranks") > 0)
