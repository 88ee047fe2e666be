"""Labelled rows to fit a classifier on, and codes for the tokens of a batch."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    usable: Column,
    per_class: int,
    max_chars: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[tuple[str, int]]:
    """At most ``per_class`` whole texts of each label (0 and 1), of at most ``max_chars`` code
    points each: the rows with the smallest hash of the id, so that a sample is the same each time.

    Ids are chosen among those that ``docs`` has such a text of, so a class is only smaller than
    ``per_class`` if there are no more; an empty one gives a warning. Only ids are shuffled and sorted;
    texts are fetched for the chosen ids alone, which are few enough to be broadcast. Null labels, ids
    and texts are left out, and an id with both labels.
    """
    given = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & usable)
        .groupBy(id_col)
        .agg(F.min(label).alias("low"), F.max(label).alias("high"))
        .where("low = high")
        .select(F.col(id_col).alias("id"), F.col("low").cast("int").alias("y"))
    )
    texts = docs.where(F.char_length(text_col) <= max_chars).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    given = stage(given.join(texts.select("id").distinct(), "id", "left_semi"))
    chosen: list[tuple] = []
    for y in (0, 1):
        ids = given.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        found = [tuple(r) for r in ids.collect()]
        if not found:
            warnings.warn(f"no usable text has the label {label} = {y}", stacklevel=2)
        chosen += found
    if not chosen:
        return []
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, given.schema))
    found = texts.join(ids, "id").select("id", "text", "y").dropDuplicates(["id"]).collect()
    return [(r["text"], r["y"]) for r in sorted(found, key=lambda r: r["id"])]


def coded(tokens: Iterable) -> tuple[np.ndarray, list]:
    """Tokens as numbers in order of first sight, and the different tokens."""
    seen: dict = {}
    codes = [seen.setdefault(t, len(seen)) for t in tokens]
    return np.array(codes, np.int32), list(seen)
