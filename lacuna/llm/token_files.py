"""Token files: frequency-ranked ids in byte-aligned variable-length codes.

A token is written as its rank by frequency in the whole corpus, in as many bytes as the rank needs;
how many is said in two bits, four tokens to a control byte, and control bytes stand apart from the
data bytes. A reader looks a control byte up in a table of lengths, so numpy finds every token's
place at once, without a branch per token.

A token file set is a folder of Parquet files (``vocabulary``: rank and id; ``tokens``: documents in
ascending id order, file after file), written by Spark's own committer. Each document has its control
and data bytes and the number of tokens before it in its file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stage
from .word_table import word_table

END = 1
#: Bytes of text encoded at once.
SLICE = 1 << 22

#: Lengths of the four codes of each control byte.
LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes end to end as one binary value per size."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and the size of each value."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, np.diff(offsets).astype(np.int64)


def tokenized(text: Column, file: str, end: int = END) -> Column:
    """The ids of each whole text and an end id, as little-endian numbers of the vocabulary's width.
    A null text counts as empty."""

    def run(texts: pa.Array) -> pa.Array:
        table = word_table(file)
        parts, sizes, waiting, size = [], [], [], 0

        def flush() -> None:
            ids, counts = table.encode(waiting)
            parts.append(np.insert(ids, np.cumsum(counts), end))  # after each text
            sizes.append(counts + 1)

        for text in texts.to_pylist():
            waiting.append((text or "").encode())
            size += len(waiting[-1])
            if size >= SLICE:
                flush()
                waiting, size = [], 0
        if waiting:
            flush()
        if not sizes:
            return pa.array([], pa.binary())
        ids = np.concatenate(parts).astype(table.dtype)
        return _binary(ids.view(np.uint8), np.concatenate(sizes) * ids.itemsize)

    return F.arrow_udf(run, "binary")(text)


def _counted(dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(_bytes_of(batch.column(0))[0].view(dtype))
            if len(found) > len(counts):
                counts, found = found, counts
            counts[: len(found)] += found
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(counts[ids], pa.int64())], ["id", "n"])

    return run


def rank_of_ids(tokens: DataFrame, dtype, vocabulary: int) -> np.ndarray:
    """For every id its rank by frequency over all documents (ties: the smaller id first). The
    vocabulary bounds what reaches the driver; ids that do not occur come last."""
    each = tokens.select("ids").mapInArrow(_counted(dtype), "id int, n bigint")
    counts = np.zeros(vocabulary, np.int64)
    for row in each.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    ranks = np.empty(vocabulary, np.int64)
    ranks[np.lexsort((np.arange(vocabulary), -counts))] = np.arange(vocabulary)
    return ranks


def pack(ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of documents end to end, and how many bytes of each a document has."""
    ranks = ranks.astype(np.uint32)
    lengths = 1 + (ranks > 0xFF) + (ranks > 0xFFFF).astype(np.int64) + (ranks > 0xFFFFFF)
    at = np.cumsum(lengths) - lengths
    data = np.zeros(int(lengths.sum()), np.uint8)
    for k in range(4):
        long_enough = lengths > k
        data[at[long_enough] + k] = (ranks[long_enough] >> np.uint32(8 * k)) & np.uint32(0xFF)
    controls = (sizes + 3) // 4
    first, padded = np.cumsum(sizes) - sizes, 4 * (np.cumsum(controls) - controls)
    codes = np.zeros(4 * int(controls.sum()), np.uint8)
    codes[np.arange(len(ranks)) + np.repeat(padded - first, sizes)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    sums = np.r_[0, np.cumsum(lengths)]
    return control, controls, data, sums[first + sizes] - sums[first]


def unpack(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranks of documents end to end, from their control and data bytes."""
    controls = (sizes + 3) // 4
    first, padded = np.cumsum(sizes) - sizes, 4 * (np.cumsum(controls) - controls)
    lengths = LENGTHS[control].ravel()[np.arange(int(sizes.sum())) + np.repeat(padded - first, sizes)]
    at = np.cumsum(lengths) - lengths
    ranks = data[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        ranks[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


FILE_ROWS = "place bigint, id bigint, n_tokens bigint, before bigint, control binary, data binary"
FILE_NAMES = [c.split()[0] for c in FILE_ROWS.split(", ")]


def _written(ranks, dtype):
    """Documents of one file, in order, to its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            raw, sizes = _bytes_of(batch.column("ids"))
            sizes = sizes // np.dtype(dtype).itemsize
            control, controls, data, spent = pack(ranks.value[raw.view(dtype)], sizes)
            sums = before + np.cumsum(sizes)
            columns = [
                batch.column("place"),
                batch.column("id"),
                pa.array(sizes, pa.int64()),
                pa.array(sums - sizes, pa.int64()),
                _binary(control, controls),
                _binary(data, spent),
            ]
            before = int(sums[-1]) if len(sums) else before
            yield pa.RecordBatch.from_arrays(columns, FILE_NAMES)

    return run


def write(docs: DataFrame, path: str, file: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the documents with a tokenizer's ``file`` and write them to ``path`` in ascending id
    order (null ids first; rows that share an id in an order of their own).

    Texts are encoded once, to a table in the shared folder. Ranks come from counts over all of it.
    Rows are dealt out by ranges of id and a checksum, so an id that many rows share is split too.
    """
    spark = docs.sparkSession
    table = word_table(file)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), tokenized(F.col(text_col), file, end).alias("ids"))
    tokens = stage(rows.withColumn("tie", F.crc32("ids")))
    ranks = rank_of_ids(tokens, table.dtype, table.tokenizer.get_vocab_size())
    in_order = tokens.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    in_order = in_order.select(F.monotonically_increasing_id().alias("place"), "id", "ids")
    sent = spark.sparkContext.broadcast(ranks.astype(np.uint32))
    in_order.mapInArrow(_written(sent, table.dtype), FILE_ROWS).write.option("compression", "zstd").parquet(f"{path}/tokens")
    pairs = [(int(r), k) for k, r in enumerate(ranks)]
    spark.createDataFrame(pairs, "rank int, id int").coalesce(1).write.parquet(f"{path}/vocabulary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a token file set: ``id, start`` (tokens of all documents before it), ``n_tokens``
    and ``ids_crc32``, the checksum of its ids as little-endian 32-bit numbers, all from the files."""
    vocabulary = spark.read.parquet(f"{path}/vocabulary").collect()
    id_of = np.zeros(len(vocabulary), np.uint32)
    for row in vocabulary:
        id_of[row["rank"]] = row["id"]
    sent = spark.sparkContext.broadcast(id_of)

    def checksums(control: pa.Array, data: pa.Array, sizes: pa.Array) -> pa.Array:
        n = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = sent.value[unpack(_bytes_of(control)[0], _bytes_of(data)[0], n)].view(np.uint8)
        ends = 4 * np.cumsum(n)
        return pa.array([zlib.crc32(ids[e - 4 * k : e]) for e, k in zip(ends.tolist(), n.tolist())], pa.int64())

    rows = spark.read.schema(FILE_ROWS).parquet(f"{path}/tokens").withColumn("file", F.shiftright("place", 33))
    # One number per file, at most as many as tasks have written.
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(starts), "file").select(
        "id",
        (F.col("first") + F.col("before")).alias("start"),
        "n_tokens",
        F.arrow_udf(checksums, "bigint")("control", "data", "n_tokens").alias("ids_crc32"),
    )


def round_trip(docs: DataFrame, file: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents as a token file set in the shared folder and read it back, one row per
    document. Empty and null texts have the end id alone; repeated rows come repeatedly; an empty
    table gives no rows."""
    path = new_path(docs.sparkSession)
    write(docs, path, file, end, id_col, text_col)
    return read(docs.sparkSession, path)
