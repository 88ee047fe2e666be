"""Scans of the dated snapshot tables.

``snapshot`` is a partition column, so every filter on it is an equality with a literal and
prunes partitions; the other filters reach the Parquet scan. ``table`` may be a catalog name or
a DataFrame that was read some other way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import require


def _frame(spark: SparkSession, table: str | DataFrame) -> DataFrame:
    return spark.table(table) if isinstance(table, str) else table


def wiki_filter(df: DataFrame, wikis: str | None) -> DataFrame:
    """Keep the wikis named in a space-separated text; ``None`` or empty text keeps all."""
    names = (wikis or "").split()
    return df.where(F.col("wiki_db").isin(names)) if names else df


def entities(spark: SparkSession, table: str | DataFrame, snapshot: str, typ: str | None = "item") -> DataFrame:
    """One snapshot of the entity table, by default only its items."""
    df = require(_frame(spark, table), "id", "typ", "snapshot").where(F.col("snapshot") == snapshot)
    return df if typ is None else df.where(F.col("typ") == typ)


def links(
    spark: SparkSession,
    table: str | DataFrame,
    snapshot: str | None = None,
    wikis: str | None = None,
) -> DataFrame:
    """Item-to-page links of one snapshot; ``snapshot=None`` gives the links of all of them."""
    df = require(_frame(spark, table), "item_id", "wiki_db", "page_id")
    if snapshot is not None:
        df = df.where(F.col("snapshot") == snapshot)
    return wiki_filter(df, wikis)


def pages(spark: SparkSession, table: str | DataFrame, snapshot: str, wikis: str | None = None) -> DataFrame:
    """Live articles of one snapshot: namespace 0 and not a redirect."""
    df = (
        require(_frame(spark, table), "wiki_db", "page_id", "page_namespace", "page_is_redirect")
        .where(F.col("snapshot") == snapshot)
        .where(F.col("page_namespace") == 0)
        .where(F.col("page_is_redirect").cast("int") == 0)
    )
    return wiki_filter(df, wikis).select("wiki_db", "page_id", "page_title")


def history(spark: SparkSession, table: str | DataFrame, snapshot: str, wikis: str | None = None) -> DataFrame:
    """Page history of one snapshot, narrowed to the columns the page operators use."""
    df = require(_frame(spark, table), "wiki_db", "page_id", "page_first_edit_timestamp").where(
        F.col("snapshot") == snapshot
    )
    return wiki_filter(df, wikis).select("wiki_db", "page_id", "page_first_edit_timestamp")
