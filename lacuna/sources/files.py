from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tfrecord import RecordSource, register

# The record schema of labelled images.
LABELLED_IMAGE = "image_file_name string, image_bytes binary, label int"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A stored feature or metric frame."""
    return spark.read.parquet(path)


#: The column that holds a line of a lookup that does not fit its schema.
BAD_LINE = "bad_line"


def read_lookup(spark: SparkSession, path: str, schema: str | None = None, bad_line: str = BAD_LINE) -> DataFrame:
    """A tab-separated lookup with a header line; every column is text.

    With a ``schema`` the columns have its types, and one more, ``bad_line``, has the whole line where a
    value does not fit or a value is missing or too many, and null elsewhere, whichever columns are read
    later. Nothing is dropped: ``split_lookup`` parts good rows from bad lines.
    """
    reader = spark.read.options(sep="\t", header=True)
    if schema is None:
        return reader.csv(path)
    read = reader.schema(f"{schema}, `{bad_line}` string").option("columnNameOfCorruptRecord", bad_line).csv(path)
    # Spark only converts the columns that are asked for, so the line is tied to all of them, of which it
    # takes nothing: a value that does not fit is found whichever columns are read.
    values = [F.col(f"`{c}`").cast("string") for c in read.columns if c != bad_line]
    return read.withColumn(bad_line, F.concat(F.col(f"`{bad_line}`"), F.substring(F.concat_ws("", *values), 1, 0)))


def split_lookup(lookup: DataFrame, bad_line: str = BAD_LINE) -> tuple[DataFrame, DataFrame]:
    """The good rows of a lookup read with a schema, in the columns of the schema; and its bad lines."""
    bad = F.col(bad_line).isNotNull()
    return lookup.where(~bad).drop(bad_line), lookup.where(bad).select(bad_line)


def read_images(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    schema: str | None = None,
    **options: str,
) -> DataFrame:
    """An image frame: Parquet, ``'tfrecord'`` (see ``tfrecord.py``; ``splitBytes`` is an option), or
    another format whose package is installed, such as ``'avro'``.

    Formats that carry no schema (TFRecord) need ``schema=LABELLED_IMAGE``.
    """
    if format == RecordSource.name():
        register(spark)
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_decoded_images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """Image files decoded by the JVM: ``image_file_name, height, width, n_channels, pixels``.

    ``pixels`` holds the bytes row by row in BGR order.
    """
    image = spark.read.format("image").option("dropInvalid", drop_invalid).load(path)
    return image.select(
        F.element_at(F.split("image.origin", "/"), -1).alias("image_file_name"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("pixels"),
    )


def write_images(images: DataFrame, path: str, format: str = "parquet", mode: str = "error", **options: str) -> None:
    """Write an image frame in a format that ``read_images`` reads."""
    if format == RecordSource.name():
        register(images.sparkSession)
        mode = "append" if mode == "error" else mode  # the writer refuses a folder that has files
    images.write.format(format).options(**options).mode(mode).save(path)


def _readable(decode_fn: Callable[[bytes], np.ndarray]):
    @F.pandas_udf("boolean")
    def readable(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def decodes(content) -> bool:
            try:
                decode_fn(content)
            except Exception:
                return False
            return True

        for contents in batches:
            yield contents.map(decodes).astype(bool)

    return readable


def ingest_images(
    spark: SparkSession,
    labelled_paths: Mapping[str, int],
    decode_fn: Callable[[bytes], np.ndarray],
    per_class_sample: int | None = None,
    pattern: str = "*",
    keep_unreadable: bool = False,
) -> DataFrame:
    """Labelled folders of files to one image frame (``LABELLED_IMAGE``).

    Files ``decode_fn`` cannot read are skipped, or with ``keep_unreadable`` marked in a further
    column ``readable``, so that they can be counted. ``per_class_sample`` takes that many files of
    each folder, the first by path: paths are listed and chosen first, without reading a content,
    and only the chosen files are read after.
    """

    def files(*paths: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths))

    def one_class(path: str, label: int) -> DataFrame:
        found = files(path)
        if per_class_sample is not None:
            chosen = [r["path"] for r in found.select("path").orderBy("path").limit(per_class_sample).collect()]
            found = files(*chosen) if chosen else found.limit(0)
        image = found.select(
            F.element_at(F.split("path", "/"), -1).alias("image_file_name"),
            F.col("content").alias("image_bytes"),
            F.lit(label).cast("int").alias("label"),
        )
        if keep_unreadable:
            return image.withColumn("readable", _readable(decode_fn)("image_bytes"))
        return image.where(_readable(decode_fn)("image_bytes"))

    return reduce(DataFrame.unionByName, [one_class(p, label) for p, label in labelled_paths.items()])


def read_log_blocks(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """Text logs as one row per block, column ``block``: the text from one line that begins with
    ``marker`` to the next, without the marker itself.

    The reader splits at the whole marker, so a large file is still read in parallel, the order of
    the lines inside a block is kept, and a line that only begins like the marker stays where it
    is. What stands before the first marker of a file is dropped: that is the first record of the
    file, unless the file opens with the marker. A marker that ends the file gives no block.
    """
    text = spark.read.text(path, lineSep="\n" + marker).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    )
    # One row per file; in a task the records of a file come in order.
    first = text.where("start = 0").groupBy("file").agg(F.min("place").alias("place"))
    records = text.join(first.withColumn("leads", F.lit(True)), ["file", "place"], "left")
    leads = F.coalesce("leads", F.lit(False))
    opens = F.startswith("value", F.lit(marker))
    block = F.when(leads, F.substring("value", len(marker) + 1, 2**31 - 1)).otherwise(F.col("value"))
    return records.where(~leads | opens).select(block.alias("block"))
