"""A bitmap of the keys a frame has, so that only rows that may match are exchanged for a join."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: at most 8 MB.
MOST_BITS = 1 << 26


def _slot(cols: Sequence[Column], bits: int) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit(bits - 1))


def _array(words: DataFrame, size: int) -> Column:
    """``words(word, bits)`` as one array of ``size`` numbers, found when the plan that uses it begins."""
    every = words.sparkSession.range(size).withColumnRenamed("id", "word").join(words, "word", "left")
    pair = F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    in_order = F.array_sort(F.collect_list(pair))
    return every.agg(F.transform(in_order, lambda p: p["bits"]).alias("bits")).scalar()


def _bits_of(slots: DataFrame, bits: int) -> Column:
    """The bitmap of ``slots(slot)``."""
    one = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    return _array(slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("bits")), bits // 64)


def _is_set(bitmap: Column, slot: Column) -> Column:
    word = F.get(bitmap, F.shiftright(slot, 6).cast("int"))
    return F.call_function("shiftright", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _size(rows: int, most: int) -> int:
    bits = 1 << 12
    while bits < 8 * rows and bits < most:
        bits *= 2
    return bits


def may_be_in(keys: DataFrame, cols: Sequence[str], rows: int | None = None, most_bits: int = MOST_BITS) -> Callable[..., Column]:
    """A test for rows of another frame, given its key columns: false only where ``keys`` lacks the key.

    About a byte per key, at most ``most_bits`` in all (``rows``: how many keys there are, if known).
    A key with a null in it is tested like others, and matches nothing in a join. A full filter lets
    more rows through, which the join drops: the result never depends on it. ``keys`` is read when the
    plan that uses the test begins, so it is best a staged frame.
    """
    bits = _size(keys.count() if rows is None else rows, most_bits)
    bitmap = _bits_of(keys.select(_slot([F.col(c) for c in cols], bits).alias("slot")), bits)
    return lambda *key: _is_set(bitmap, _slot([F.col(k) if isinstance(k, str) else k for k in key], bits))


def may_repeat(df: DataFrame, cols: Sequence[str], copies: str | None = None, rows: int | None = None, most_bits: int = MOST_BITS) -> Column:
    """A test for rows of ``df``: false only where no other row has their value of ``cols``.

    What is exchanged for it is a number per slot, not the values. ``copies`` names a column that says
    how many rows each row stands for.
    """
    bits = _size(df.count() if rows is None else rows, most_bits)
    number = F.count("*") if copies is None else F.sum(copies)
    slots = df.groupBy(_slot([F.col(c) for c in cols], bits).alias("slot")).agg(number.alias("n"))
    return _is_set(_bits_of(slots.where("n > 1"), bits), _slot([F.col(c) for c in cols], bits))
