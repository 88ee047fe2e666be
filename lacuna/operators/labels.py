from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import require
from ..sources.sinks import as_it_is

#: What keeps a frame for several reads: ``sources.Staging(spark)``, or nothing.
Stage = Callable[[DataFrame], DataFrame]


def labels_in(entities: DataFrame, lang: str = "en") -> DataFrame:
    """``id, label`` of the entities that have a label in one language.

    The label is looked up in the map; the map is not exploded into all its languages.
    """
    return (
        require(entities, "id", "labels")
        .select("id", F.try_element_at("labels", F.lit(lang)).alias("label"))
        .where(F.col("label").isNotNull())
    )


def add_label(df: DataFrame, col: str, labels: DataFrame, name: str = "label", how: str = "inner") -> DataFrame:
    """Add the label of the entity in ``col`` from ``labels`` (``id, label``).

    The default drops rows whose entity is null, unknown or has no label; ``how='left'`` keeps
    them. No side is hinted: the labels of a whole snapshot are large, those in use
    (``labels_in_use``) mostly few, and Catalyst broadcasts by size. In a join that shuffles, AQE
    splits a hot entity on the left (see ``session.tune``), also under an aggregate on it.
    """
    names = require(labels, "id", "label").select(F.col("id").alias(col), F.col("label").alias(name))
    return require(df, col).join(names, col, how).select(*df.columns, name)


def labels_in_use(labels: DataFrame, df: DataFrame, col: str, stage: Stage = as_it_is) -> DataFrame:
    """The labels of the entities that occur in ``col``.

    With ``stage`` (``sources.Staging``) both the entities and their labels come back from files of
    known size; ``df`` is best staged itself. Where they are few, as categories are, Catalyst
    broadcasts them: neither the labels of the snapshot nor ``df`` is then shuffled, and no entity
    is a hot key. Where they are many it joins them by shuffling.
    """
    used = stage(require(df, col).select(F.col(col).alias("id")).distinct())
    return stage(require(labels, "id", "label").join(used, "id", "left_semi").select("id", "label"))


def label_list(df: DataFrame, array_col: str, labels: DataFrame, name: str = "labels") -> DataFrame:
    """Add an array with the label of every id in ``array_col``, in place; an unknown id gives null.

    What comes out depends on the array alone: equal arrays are labelled once, and rows need no key.
    An array is taken apart and put together again, so no group is larger than an array.
    """
    arrays = require(df, array_col).select(F.col(array_col).alias("ids")).where(F.col("ids").isNotNull()).distinct()
    parts = arrays.select("ids", F.posexplode("ids").alias("pos", "id"))
    entry = F.struct("pos", "label")
    rebuilt = (
        add_label(parts, "id", labels, "label", "left")
        .groupBy("ids")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select(F.col("ids").alias(array_col), F.transform("entries", lambda e: e["label"]).alias(name))
    )
    # An empty array gives no parts: its label array is empty, that of a null array null.
    empty = F.when(F.col(array_col).isNotNull(), F.array().cast("array<string>"))
    return df.join(rebuilt, array_col, "left").select(*df.columns, F.coalesce(name, empty).alias(name))
