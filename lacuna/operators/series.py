"""Monthly series in long form."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import require, year_month

MONTH = ["year", "month"]


def monthly_counts(df: DataFrame, ts: str, keys: Sequence[str], name: str = "article_count") -> DataFrame:
    """Rows per key and month of ``ts``; the columns are the first key, year, month, other keys."""
    first, *others = keys
    return (
        require(df, ts, *keys)
        .select(*keys, *year_month(ts))
        .groupBy(first, *MONTH, *others)
        .agg(F.count("*").alias(name))
    )


def running_sum(
    df: DataFrame,
    value: str,
    partition: Sequence[str],
    name: str = "cumsum",
    order: Sequence[str] = MONTH,
) -> DataFrame:
    """Add the running sum of ``value``.

    A partition is sorted in one task, so ``df`` should be counted per month already: then the
    calendar bounds the partition, whatever the number of rows counted.
    """
    window = Window.partitionBy(*partition).orderBy(*order)
    return require(df, value, *partition, *order).withColumn(name, F.sum(value).over(window))


def monthly_cumulative(
    df: DataFrame,
    ts: str = "date_created",
    keys: Sequence[str] = ("wiki_db", "gender_label"),
    count: str = "article_count",
    cumsum: str = "cumsum",
) -> DataFrame:
    """Rows per key and month and their running sum; rows without a time are left out."""
    dated = require(df, ts).where(F.col(ts).isNotNull())
    return running_sum(monthly_counts(dated, ts, keys, count), count, keys, cumsum)


def slice_metric(df: DataFrame, **equals: Any) -> DataFrame:
    """Keep the rows where each named column has the given value; ``None`` means null.

    Stored labels carry their JSON quotes: compare with ``'"female"'``.
    """
    require(df, *equals)
    for name, value in equals.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def top_k(df: DataFrame, by: str, k: int = 10, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ``ties`` decide between equal ones."""
    return require(df, by, *ties).orderBy(F.desc(by), *ties).limit(k)
