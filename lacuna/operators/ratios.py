"""Counts per category and what they are a share of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import entity_id, percent, require
from ..sources.sinks import as_it_is
from .claims import claims_of
from .labels import Stage, add_label, labels_in_use
from .series import MONTH, monthly_counts, running_sum


def share_of_total(
    df: DataFrame,
    keys: Sequence[str],
    count: str = "count",
    total: str = "total",
    ratio: str = "ratio",
) -> DataFrame:
    """Rows per key, rows in all, and the first as a percentage of the second; largest first.

    The total is a scalar subquery over the same grouped counts, so the input is aggregated once.
    """
    grouped = require(df, *keys).groupBy(*keys).agg(F.count("*").alias(count))
    whole = grouped.agg(F.sum(count)).scalar()
    return (
        grouped.withColumn(total, whole)
        .withColumn(ratio, percent(count, total))
        .orderBy(F.desc(count), *keys)
    )


def coverage_ratio(
    part: DataFrame,
    whole: DataFrame,
    by: Sequence[str],
    key: str,
    label: str | None = None,
    count: str = "article_count",
    total: str = "gender_count",
    ratio: str = "article_ratio",
) -> DataFrame:
    """Rows of ``part`` per ``by`` and ``key``, as a percentage of the rows of ``whole`` per ``key``.

    Both sides are counted before they are joined. A null key matches nothing. ``label`` is a
    column that goes with the key; the one of ``part`` is kept.
    """
    keys = [key] if label is None else [key, label]
    parts = require(part, *by, *keys).groupBy(*by, *keys).agg(F.count("*").alias(count))
    wholes = require(whole, *keys).groupBy(*keys).agg(F.count("*").alias(total)).select(key, total)
    return (
        parts.join(wholes, key)
        .select(*by, *keys, count, total)
        .withColumn(ratio, percent(count, total))
        .orderBy(F.desc(count), *by, *keys)
    )


def flag_ratio(
    df: DataFrame,
    flag: str,
    key: str,
    label: str | None = None,
    count: str = "zero_ill_count",
    total: str = "gender_count",
    ratio: str = "zero_ill_ratio",
) -> DataFrame:
    """Rows with a true flag per key, as a percentage of all rows of that key; largest first.

    One pass counts both. Keys without a flagged row, and the null key, are left out. ``label``
    goes with the key, one label per key.
    """
    keys = [key] if label is None else [key, label]
    return (
        require(df, flag, *keys)
        .where(F.col(key).isNotNull())
        .groupBy(*keys)
        .agg(F.count_if(F.col(flag)).alias(count), F.count("*").alias(total))
        .where(F.col(count) > 0)
        .withColumn(ratio, percent(count, total))
        .orderBy(F.desc(count), *keys)
    )


def monthly_share(
    pages: DataFrame,
    totals: DataFrame,
    ts: str = "page_first_edit_timestamp",
    key: Sequence[str] = ("gender", "gender_label"),
    wiki: str = "wiki_db",
    until: str | None = None,
) -> DataFrame:
    """Pages per wiki, month and category against all pages of the wiki, monthly and cumulative.

    ``totals`` has ``wiki, year, month, wp_count, wp_cumsum``. Months that only one side knows
    stay, with nulls for the other. The last key column is the one shown. ``until`` (``yyyy-MM``)
    cuts off later months, of which a snapshot holds only a part; rows without a month stay.
    """
    dated = require(pages, ts, wiki, *key).where(F.col(ts).isNotNull())
    counted = monthly_counts(dated, ts, [wiki, *key])
    series = running_sum(counted, "article_count", [wiki, *key])
    share = (
        series.join(require(totals, wiki, *MONTH, "wp_count", "wp_cumsum"), [wiki, *MONTH], "outer")
        .withColumn("monthly_article_ratio", percent("article_count", "wp_count"))
        .withColumn("article_ratio", percent("cumsum", "wp_cumsum"))
        .select(wiki, *MONTH, key[-1], "article_count", "monthly_article_ratio", "cumsum", "article_ratio")
    )
    return share if until is None else share.where(F.concat_ws("-", *MONTH) <= until)


def monthly_pct(series: DataFrame, totals: DataFrame, wiki: str = "wiki_db") -> DataFrame:
    """A series against the totals of its wiki and month, in percent with three decimals.

    Both have ``wiki, year, month, article_count, cumsum``; those of the totals become
    ``wp_count, wp_cumsum``. The result is sorted by time.
    """
    whole = require(totals, wiki, *MONTH, "article_count", "cumsum").select(
        wiki, *MONTH, F.col("article_count").alias("wp_count"), F.col("cumsum").alias("wp_cumsum")
    )
    others = [c for c in series.columns if c not in (wiki, *MONTH, "article_count", "cumsum")]
    return (
        require(series, wiki, *MONTH, "article_count", "cumsum")
        .join(whole, [wiki, *MONTH])
        .withColumn("monthly_pct", F.round(percent("article_count", "wp_count"), 3))
        .withColumn("accumulated_pct", F.round(percent("cumsum", "wp_cumsum"), 3))
        .orderBy(*MONTH, wiki, *others)
    )


def category_counts(
    items: DataFrame, col: str, labels: DataFrame, label: str = "label", stage: Stage = as_it_is
) -> DataFrame:
    """Items per category with its label, largest first; the null category has no label and goes.

    Items are counted before the label is looked up, so only categories are joined; with ``stage``
    (``sources.Staging``) few of them are broadcast and the labels are not shuffled.
    """
    counted = stage(require(items, col).groupBy(col).agg(F.count("*").alias("count")))
    return add_label(counted, col, labels, label).orderBy(F.desc("count"), col)


def multi_valued(
    props: DataFrame,
    prop: str,
    labels: DataFrame,
    key: str = "qitem_id",
    name: str = "value",
    label: str = "label",
    stage: Stage = as_it_is,
    ordered: bool = True,
) -> DataFrame:
    """Items with more than one value of a property: one row per item and different value.

    ``count`` is the number of values of the item, repeats included, and ``times`` how often this
    one occurs; null values are not counted. An id without a label keeps its row with a null
    label. In long form no item, however many values it has, is gathered in one place. With
    ``stage`` (``sources.Staging``) the rows are written once and only the labels in use are joined.
    ``ordered=False`` leaves out the last sort, for a step that sorts anyway.
    """
    per_value = (
        claims_of(require(props, key, "value"), prop)
        .select(key, entity_id("value").alias(name))
        .groupBy(key, name)
        .agg(F.count(name).alias("times"))
        .where(F.col("times") > 0)  # a null id counts nothing; a test of the id would read the JSON twice
    )
    several = per_value.groupBy(key).agg(F.sum("times").alias("count")).where(F.col("count") > 1)
    found = stage(per_value.join(several, key))
    used = labels if stage is as_it_is else labels_in_use(labels, found, name, stage)
    rows = add_label(found, name, used, label, "left").select(key, "count", name, label, "times")
    return rows.orderBy(F.desc("count"), key, name) if ordered else rows


def value_lists(values: DataFrame, key: str = "qitem_id", name: str = "value", label: str = "label") -> DataFrame:
    """The result of ``multi_valued`` (take ``ordered=False``) with one row per item: ``count`` and three
    arrays side by side.

    They hold the ids, the labels (null where unknown) and how often each occurs, sorted by id.
    Every different value stands once, so a row is bounded by the number of categories and not by
    the number of claims an item has; ``functions.spelled_out`` repeats the entries of an array.
    """
    entry = F.struct(name, label, "times")
    gathered = require(values, key, "count", name, label, "times").groupBy(key, "count")
    rows = gathered.agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return rows.select(
        key,
        "count",
        F.col(f"entries.{name}").alias(f"{name}_list"),
        F.col(f"entries.{label}").alias(f"{label}_list"),
        F.col("entries.times").alias("times_list"),
    ).orderBy(F.desc("count"), key)
