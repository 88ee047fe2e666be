"""Joins between items and the pages they link to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import require
from ..sources.sinks import as_it_is
from ..sources.tables import wiki_filter
from .filters import may_repeat
from .labels import Stage


def add_missing_flag(
    df: DataFrame,
    other: DataFrame,
    left_key: str = "qid",
    right_key: str = "item_id",
    name: str = "zero_ill",
) -> DataFrame:
    """Add a flag: true when ``other`` has no row for the key. A null key gives false.

    Every row of ``other`` counts, so pass all snapshots or one, as wanted. Its keys are folded to
    one row each before the join: the flag cannot multiply rows and a hot key shuffles as one row.
    """
    require(df, left_key)
    seen = f"{name}_seen"
    known = require(other, right_key).select(F.col(right_key).alias(left_key)).distinct().withColumn(seen, F.lit(True))
    missing = F.col(seen).isNull() & F.col(left_key).isNotNull()
    return df.join(known, left_key, "left").select(*df.columns, missing.alias(name))


def pages_of_items(items: DataFrame, links: DataFrame, wikis: str | None = None, key: str = "qid") -> DataFrame:
    """``qid, wiki_db, page_id, page_title`` of the pages the items link to."""
    require(items, key)
    linked = wiki_filter(require(links, "item_id", "wiki_db", "page_id", "page_title"), wikis)
    return (
        items.select(key)
        .join(linked.withColumnRenamed("item_id", key), key)
        .select(key, "wiki_db", "page_id", "page_title")
    )


def drop_ambiguous(
    df: DataFrame,
    key_sets: Sequence[Sequence[str]] = (("page_title", "wiki_db"), ("page_id", "wiki_db")),
    copies: str | None = None,
    stage: Stage = as_it_is,
    candidates: bool = False,
) -> DataFrame:
    """Remove every row whose value of some key set occurs more than once in ``df``.

    All counts are taken on the frame as given. A key with a null in it matches nothing, so its
    rows stay. ``copies`` names a column that says how many rows each row stands for. The counts
    are pre-aggregated, and only the repeated keys meet the rows again. With ``stage``
    (``sources.Staging``) those keys are written first: few of them are then broadcast, and the rows
    of ``df``, best staged too, are not shuffled at all. With ``candidates`` nor are their titles: a
    bitmap of hashes tells first which rows may be repeated, and only these are counted by their keys.
    It costs a look at the hashes, and pays where keys are long and seldom repeated.
    """
    out = df
    number = F.count("*") if copies is None else F.sum(copies)
    rows = df.count() if candidates else None
    for keys in key_sets:
        counted = require(df, *keys).where(may_repeat(df, keys, copies, rows)) if candidates else require(df, *keys)
        repeated = counted.groupBy(*keys).agg(number.alias("n")).where(F.col("n") > 1).select(*keys)
        out = out.join(stage(repeated), list(keys), "left_anti")
    return out.select(*df.columns)
