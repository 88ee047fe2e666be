"""A bitmap of hashes, built by Spark and bounded in size, that says for sure that a key is absent."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: at most 32 MB. Beyond it more absent keys look present.
MOST_BITS = 1 << 28


class Bitmap:
    def __init__(self, bits: int, blocks: np.ndarray):
        self.bits, self.blocks = bits, blocks

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys (signed 64-bit hashes) may be among those the bitmap was built from."""
        at = keys.astype(np.int64) & (self.bits - 1)
        # Blocks are numbered from 1 and hold 32,768 bits each, the lowest bit of a byte first.
        byte = self.blocks[at // 32768 + 1, at % 32768 // 8]
        return (byte >> (at % 8).astype(np.uint8) & 1).astype(bool)


def bitmap_of(keys: DataFrame) -> Bitmap:
    """The bitmap of ``keys(key bigint)``, hashes: two bytes a key, at most ``MOST_BITS`` in all. Blocks
    of 4 KB are made by a partial aggregate, so what travels is bounded too."""
    rows, bits = keys.count(), 1 << 18
    while bits < min(16 * rows, MOST_BITS):
        bits *= 2
    slot = keys.select((F.col("key").bitwiseAND(F.lit(bits - 1)) + 1).alias("slot"))  # Spark's bitmaps count from 1
    found = F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    blocks = slot.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(found)
    out = np.zeros((bits // 32768 + 2, 4096), np.uint8)
    for row in blocks.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return Bitmap(bits, out)
