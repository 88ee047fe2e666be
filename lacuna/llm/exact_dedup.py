"""Exact deduplication: a two-pass Bloom filter, so that only possible repeats are shuffled.

Pass one writes a digest of every row (never its text) and adds its hash to a filter with two bits
per slot, "seen" and "seen again". Pass two sends only rows whose slots were all seen again through
the shuffle that groups equal texts; all other rows are certainly alone and pass straight through.

The filter holds about four bytes per row up to ``filter_mb``; that bound is what is broadcast and
merged. Beyond it more rows count as possible repeats: results stay exact, only more digests (never
texts) are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stage, unpacked

#: Slots looked at for each row.
PROBES = 2
#: Slots of one block, the unit in which filters are merged.
BLOCK_SLOTS = 1 << 18

DIGEST = "struct<sha: binary, points: bigint>"


def _digest(texts: pa.Array) -> pa.Array:
    found = [t or "" for t in texts.to_pylist()]
    return pa.StructArray.from_arrays(
        [
            pa.array([hashlib.sha256(b"".join(t.encode().split())).digest() for t in found], pa.binary()),
            pa.array([len(t) for t in found], pa.int64()),
        ],
        ["sha", "points"],
    )


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space, and the code points of the text as it is. Marked so that
    Spark evaluates it once per row."""
    return F.arrow_udf(_digest, DIGEST).asNondeterministic()(text)


def _slots(shas: list[bytes], slots: int) -> np.ndarray:
    words = np.frombuffer(b"".join(s[: 8 * PROBES] for s in shas), np.uint64).reshape(-1, PROBES)
    return (words % np.uint64(slots)).astype(np.int64)


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


def _marked(slots: int):
    """One task's filter, two bits per slot: the blocks that have a bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = np.zeros(slots // 8, np.uint8), np.zeros(slots // 8, np.uint8)
        for batch in batches:
            if batch.num_rows:
                # The slots of one row count once: a row must not repeat itself.
                at = np.sort(_slots(batch.column(0).to_pylist(), slots), axis=1)
                own = np.concatenate([at[:, 0], at[at[:, 1] != at[:, 0], 1]])
                found, n = np.unique(own, return_counts=True)
                _set(again, found[(n > 1) | _bit(seen, found)])
                _set(seen, found)
        size = BLOCK_SLOTS // 8
        for k in range(0, len(seen), size):
            if seen[k : k + size].any():
                yield pa.RecordBatch.from_pydict(
                    {"block": [k // size], "seen": [seen[k : k + size].tobytes()], "again": [again[k : k + size].tobytes()]},
                    pa.schema([("block", pa.int64()), ("seen", pa.binary()), ("again", pa.binary())]),
                )

    return run


def _merged(key: tuple[pa.Scalar, ...], blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filters of all tasks for one block, one at a time: seen again in one task, or seen in two."""
    seen = again = None
    for batch in blocks:
        for s, a in zip(batch.column("seen").to_pylist(), batch.column("again").to_pylist()):
            s, a = np.frombuffer(s, np.uint8), np.frombuffer(a, np.uint8)
            again = a.copy() if seen is None else again | a | (seen & s)
            seen = s.copy() if seen is None else seen | s
    yield pa.RecordBatch.from_pydict(
        {"block": [key[0].as_py()], "again": [again.tobytes()]}, pa.schema([("block", pa.int64()), ("again", pa.binary())])
    )


def repeat_filter(digests: DataFrame, filter_mb: int = 32) -> np.ndarray:
    """Bits of the slots that more than one row has, from all rows of ``digests(sha)``; at most
    ``filter_mb``. Filters are built by a number of tasks that grows slower than the input, as each
    task sends a whole filter to the merge."""
    rows = digests.count()
    slots = BLOCK_SLOTS
    while slots < 16 * rows and slots < filter_mb << 23:
        slots *= 2
    tasks = max(8, min(1024, int(rows**0.5) // 16))
    parts = digests.select("sha").coalesce(tasks).mapInArrow(_marked(slots), "block bigint, seen binary, again binary")
    blocks = parts.groupBy("block").applyInArrow(_merged, "block bigint, again binary")
    bits = np.zeros(slots // 8, np.uint8)
    for row in blocks.toLocalIterator():  # at most filter_mb in all
        at = row["block"] * BLOCK_SLOTS // 8
        bits[at : at + BLOCK_SLOTS // 8] = np.frombuffer(row["again"], np.uint8)
    return bits


def _seen_again(shas: pa.Array, bits: np.ndarray) -> pa.Array:
    if not len(shas):
        return pa.array([], pa.bool_())
    return pa.array(_bit(bits, _slots(shas.to_pylist(), 8 * len(bits))).all(axis=1))


def _maybe(sent: Broadcast):
    """A UDF of hashes: were all slots seen again?"""

    @F.arrow_udf("boolean")
    def maybe(shas: pa.Array) -> pa.Array:
        return _seen_again(shas, sent.value)

    return maybe


def _flagged_digest(sent: Broadcast):
    """A UDF of texts: their digest with a flag ``maybe``, in one step."""

    @F.arrow_udf("struct<sha: binary, points: bigint, maybe: boolean>")
    def flagged(texts: pa.Array) -> pa.Array:
        sha, points = _digest(texts).flatten()
        return pa.StructArray.from_arrays([sha, points, _seen_again(sha, sent.value)], ["sha", "points", "maybe"])

    return flagged.asNondeterministic()


def _sent_filter(rows: DataFrame, filter_mb: int) -> Broadcast:
    return rows.sparkSession.sparkContext.broadcast(repeat_filter(rows, filter_mb))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, sha, points, tag`` of every row, written once; ``tag`` tells repeated rows apart."""
    return stage(
        docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("d"))
        .select("id", "d.sha", "d.points")
        .withColumn("tag", F.monotonically_increasing_id())
    )


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_mb: int = 32) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree without white space (tab to carriage return, and the blank). Of
    equal texts the one with the most code points stays, then the smallest id; a null id loses to
    any other; of rows that agree in all of that (repeated rows) one stays. A null text counts as
    empty, and empty texts equal each other. An empty table gives no rows.
    """
    rows = digests(docs, id_col, text_col)
    flagged = rows.withColumn("maybe", _maybe(_sent_filter(rows, filter_mb))("sha"))
    alone = flagged.where("not maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    repeats = flagged.where("maybe")
    order = F.struct(-F.col("points"), F.col("id").isNull(), F.col("id").alias("keep_id"), F.col("tag").alias("keep_tag"))
    # Written, so that both sides of the join are plain exchanges and AQE can split a frequent text.
    best = stage(repeats.groupBy("sha").agg(F.min(order).alias("best"), F.count("*").alias("group_size")))
    grouped = repeats.join(best, "sha").select(
        "id", F.col("best.keep_id"), "group_size", (F.col("tag") == F.col("best.keep_tag")).alias("kept"), "sha"
    )
    return alone.unionByName(grouped).select(
        "id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_mb: int = 32) -> DataFrame:
    """The rows that stay, in the columns of ``docs``, by the rules of :func:`decisions`.

    Rows that are certainly alone are never shuffled; a possible repeat meets the winner of its
    text in a join that AQE splits when one text is very frequent.
    """
    rows = digests(docs, id_col, text_col)
    sent = _sent_filter(rows, filter_mb)
    repeats = rows.where(_maybe(sent)("sha"))
    order = F.struct((-F.col("points")).alias("less"), F.col("id").isNull(), F.col("id").alias("keep_id"))
    # Written, so that AQE can split a text that a third of the rows have.
    best = stage(repeats.groupBy("sha").agg(F.min(order).alias("best")))
    wins = repeats.join(best, "sha").where("points = -best.less").where(F.col("id").eqNullSafe(F.col("best.keep_id")))
    winners = stage(
        wins.groupBy("sha").agg(F.first("points").alias("points"), F.first("id").alias("keep_id"), F.count("*").alias("rows"))
    )

    marked = packed(docs, F.col(id_col).alias("id"), _flagged_digest(sent)(F.col(text_col)).alias("d")).select("row", "id", "d.*")
    alone = marked.where("not maybe").select("row")
    first = (
        marked.where("maybe")
        .join(winners, ["sha", "points"])
        .where(F.col("id").eqNullSafe(F.col("keep_id")))
        .select("row", "sha")
    )
    if winners.where("rows > 1").head(1):  # repeated rows: one of each text, whichever
        first = first.groupBy("sha").agg(F.first("row").alias("row"))
    return unpacked(alone.unionByName(first.select("row")), docs)
