"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has the bits that more than half of the hashes of its word shingles have. Two
fingerprints link when they differ in few bits. They are cut into two segments; by the pigeonhole
principle two fingerprints at distance 2 or less differ in at most one bit of the first segment, or
in none of the second. So every different fingerprint stands in a table under each of its segments,
and asks the table of the first segment for the Hamming ball of radius 1 around its own value
(asking for the values with one more bit set is enough, the partner finds the others). What meets
under one key is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stage, unpacked
from .components import components

SEED = 42
HALF = 32
#: Fingerprints that meet under one key and are verified against each other in one task.
BUCKET = 2_048
#: Hashes whose bits are unpacked at once.
CHUNK = 1 << 18


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every run of ``width`` words, repeats included; of all words where there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    flat = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(flat, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    hash64 = xxhash.xxh64_intdigest
    return [hash64(flat[a : b - 1], SEED) for a, b in zip([0, *ends], ends[width - 1 :])]


def majority(hashes: list[int]) -> int:
    """The bits set in more than half of the hashes; none for no hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = np.array(hashes[k : k + CHUNK], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(width: int):
    """An Arrow UDF from texts to fingerprints, as signed longs. A null text has no words. It is marked
    so that Spark evaluates it once per row and copies it into no filter."""

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        found = [majority(shingle_hashes(t, width)) for t in texts.to_pylist()]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return prints.asNondeterministic()


def _keys(max_bits: int) -> Column:
    """The keys of a fingerprint, each marked if it only asks: the upper half, the lower half with a mark above it,
    and at two bits the ball around the upper half."""
    upper = F.shiftrightunsigned("fp", HALF)
    lower = F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1)) + F.lit(1 << HALF)
    keys = F.array(
        F.struct(upper.alias("key"), F.lit(False).alias("asks")), F.struct(lower.alias("key"), F.lit(False).alias("asks"))
    )
    if max_bits < 2:
        return keys
    bits = F.array(*[F.lit(1 << j).cast("bigint") for j in range(HALF)])
    ball = F.transform(
        F.filter(bits, lambda b: upper.bitwiseAND(b) == 0),
        lambda b: F.struct((upper + b).alias("key"), F.lit(True).alias("asks")),
    )
    return F.concat(keys, ball)


def _spanning(fp: np.ndarray, asks: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Links enough to connect what is linked under one key: each fingerprint in turn is compared
    with all, but links inside a class already joined are not returned."""
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = [], []
    for i in np.flatnonzero(~asks):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= max_bits):
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                left.append(i)
                right.append(j)
    return left, right


def _verified(max_bits: int):
    """Links (a, b) within the keys of a partition sorted by key, batch by batch; the rows of a key
    that goes on in the next batch wait for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

        def links(key, fp, asks):
            a, b = [], []
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(key)])
            for s, n in zip(starts[sizes > 1], sizes[sizes > 1]):
                x, y = _spanning(fp[s : s + n], asks[s : s + n], max_bits)
                a += [s + i for i in x]
                b += [s + i for i in y]
            return pa.RecordBatch.from_arrays([pa.array(fp[a], pa.int64()), pa.array(fp[b], pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            key, fp, asks = (np.concatenate(x) for x in zip(kept, new))
            cut = int(np.searchsorted(key, key[-1]))
            yield links(key[:cut], fp[:cut], asks[:cut])
            kept = [key[cut:], fp[cut:], asks[cut:]]
        yield links(*kept)

    return run


def links(prints: DataFrame, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints ``prints(fp)``, whose connected components
    are those of all pairs at ``max_bits`` (0 to 2) or fewer differing bits.

    Not every pair is returned: inside one key a spanning set is. Keys with more than ``bucket``
    fingerprints are not gathered at all. Their fingerprints are linked in another exact way, in
    which no group is compared: two fingerprints are at distance 2 or less if and only if some
    64-bit value is at distance 1 or less from both, so each emits the 65 values around it and is
    linked with the smallest fingerprint of each value (at one bit: the 64 values with one bit
    cleared, each under its own mark).
    """
    if max_bits not in (0, 1, 2):
        raise ValueError(f"max_bits has to be 0, 1 or 2: {max_bits}")
    rows = prints.select("fp", F.explode(_keys(max_bits)).alias("k"))
    rows = stage(rows.select("k.key", "fp", "k.asks"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("asks")).alias("own"))
    sizes = sizes.where("n > 1 and own > 0")
    met = rows.join(sizes.where(F.col("n") <= bucket).select("key"), "key").select("key", "fp", "asks")
    small = met.repartition("key").sortWithinPartitions("key").mapInArrow(_verified(max_bits), "a bigint, b bigint")

    many = rows.join(sizes.where(F.col("n") > bucket).select("key"), "key", "left_semi").select("fp").distinct()
    bits = F.array(*[F.lit(1 << j if j < 63 else -(1 << 63)).cast("bigint") for j in range(64)])

    def value(mark: Column, at: Column) -> Column:
        return F.struct(mark.cast("int").alias("mark"), at.alias("at"))

    if max_bits == 2:
        same = F.array(value(F.lit(0), F.col("fp")))
        around = F.concat(same, F.transform(bits, lambda b: value(F.lit(0), F.col("fp").bitwiseXOR(b))))
    else:
        around = F.transform(bits, lambda b, j: value(j, F.col("fp").bitwiseAND(F.bitwise_not(b))))
    around = many.select("fp", F.explode(around).alias("v")).select("fp", "v.mark", "v.at")
    hubs = around.groupBy("mark", "at").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    large = around.join(hubs, ["mark", "at"]).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return small.unionByName(large) if max_bits else small.limit(0)


def classes(
    docs: DataFrame, width: int = 3, max_bits: int = 2, id_col="doc_id", text_col="text", bucket: int = BUCKET
) -> tuple[DataFrame, DataFrame]:
    """Fingerprints ``(id, fp)`` of all rows, and classes ``(fp, component_id, rows)``: the smallest
    id of the rows whose fingerprints reach each other, and how many rows have that id."""
    prints = stage(docs.select(F.col(id_col).alias("id"), fingerprint(width)(F.col(text_col)).alias("fp")))
    each = stage(prints.groupBy("fp", "id").agg(F.count("*").alias("rows")))
    per = each.groupBy("fp").agg(F.min("id").alias("first"))
    root = components(links(per.select("fp"), max_bits, bucket)).withColumnsRenamed({"node": "fp"})
    rooted = per.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = stage(rooted.join(least, "root").select("fp", "root", "component_id"))
    holders = each.join(found, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    holders = holders.groupBy("root").agg(F.sum("rows").alias("rows"))
    return prints, found.join(holders, "root").select("fp", "root", "component_id", "rows")


def near_duplicates(
    docs: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET
) -> DataFrame:
    """One row per input row: ``id, fingerprint`` (16 hex digits) and ``component_id``, the smallest
    id of its component.

    Words are what white space parts, after lower-casing A-Z. A null, empty or blank text has the
    fingerprint zero and is linked like any other. Null ids lose to others; a component of null ids
    has a null component_id. Repeated rows come repeatedly. An empty table gives no rows. Equal
    fingerprints are folded before anything is linked, so a group of copies counts once.
    """
    prints, found = classes(docs, width, max_bits, id_col, text_col, bucket)
    return prints.join(found.select("fp", "component_id"), "fp").select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET
) -> DataFrame:
    """One row of each component, the one with the smallest id, in the columns of ``docs``. Where
    several rows have that id, one of them."""
    _, found = classes(docs, width, max_bits, id_col, text_col, bucket)
    found = stage(found)
    rows = packed(docs, F.col(id_col).alias("id"), fingerprint(width)(F.col(text_col)).alias("fp"))
    kept = rows.join(found, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    if found.where("rows > 1").head(1):
        kept = kept.groupBy("root").agg(F.first("row").alias("row"))
    return unpacked(kept, docs)
