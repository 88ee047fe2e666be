"""Claims: the statements an entity makes, as nested arrays or as a long property frame."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import claim_matches, entity_id, require

Flags = Mapping[str, tuple[str, str]]
Values = Mapping[str, str]


def explode_claims(entities: DataFrame, key: str = "id") -> DataFrame:
    """One row per claim: ``key, property, value``. Entities without claims give no row.

    The rows come from two plain arrays zipped together: so the scan reads these two leaves of a
    claim and no others, which it does not when the claims themselves are exploded.
    """
    pairs = F.arrays_zip(
        F.col("claims.mainSnak.property").alias("property"),
        F.col("claims.mainSnak.datavalue.value").alias("value"),
    )
    return require(entities, key, "claims").select(key, F.inline(pairs))


def claims_of(props: DataFrame, prop: str) -> DataFrame:
    """The claims about one property."""
    return require(props, "property").where(F.col("property") == prop)


def _wanted(flags: Flags, values: Values, strict: bool, claim: Column | None = None) -> Column:
    """True for the claims some feature needs."""
    tests = [claim_matches(p, q, strict, claim) for p, q in flags.values()]
    if values:
        of = F.col("property") if claim is None else claim["property"]
        tests.append(of.isin(sorted(set(values.values()))))
    if not tests:
        raise ValueError("name at least one flag or value")
    return reduce(Column.__or__, tests)


def pivot_claims(
    claims: DataFrame,
    flags: Flags | None = None,
    values: Values | None = None,
    key: str = "id",
    strict: bool = False,
) -> DataFrame:
    """Long claims to one row per item that has a claim of interest.

    ``flags`` maps a column name to ``(property, entity)``: true when some claim says so.
    ``values`` maps a column name to a property: the entity it points to, the largest JSON text
    winning where an item has several. Claims of other kinds are dropped where they are scanned.

    A maximum of texts is found by sorting, so equal claims are folded by hash first, and only the
    claims left are brought together by item and sorted.
    """
    flags, values = flags or {}, values or {}
    features = [
        F.coalesce(F.max(claim_matches(p, q, strict)), F.lit(False)).alias(name) for name, (p, q) in flags.items()
    ]
    features += [F.max(F.when(F.col("property") == p, F.col("value"))).alias(name) for name, p in values.items()]
    wanted = require(claims, key, "property", "value").where(_wanted(flags, values, strict))
    pivoted = wanted.select(key, "property", "value").distinct().repartition(key).groupBy(key).agg(*features)
    return pivoted.select(key, *flags, *[entity_id(name).alias(name) for name in values])


def entity_features(
    entities: DataFrame,
    flags: Flags | None = None,
    values: Values | None = None,
    key: str = "id",
    strict: bool = False,
    all_items: bool = False,
) -> DataFrame:
    """The features of ``pivot_claims`` from the nested claims of entities, one row per ``key``.

    Each row is folded where it stands, by array functions over the two leaves of a claim that are
    read; claims are never exploded. Entities without a claim of interest are left out, or with
    ``all_items`` kept with false flags and null values. An entity in several rows has the claims of
    all of them: equal rows are folded by hash, and only what is left is brought together.
    """
    flags, values = flags or {}, values or {}
    property_, value = F.col("claims.mainSnak.property"), F.col("claims.mainSnak.datavalue.value")
    claims = F.filter(
        F.arrays_zip(property_.alias("property"), value.alias("value")), lambda c: _wanted(flags, values, strict, c)
    )
    found = require(entities, key, "claims").select(key, claims.alias("wanted"))
    if not all_items:
        found = found.where(F.size("wanted") > 0)

    def said(prop: str, qid: str) -> Column:
        matches = F.exists("wanted", lambda c: F.coalesce(claim_matches(prop, qid, strict, c), F.lit(False)))
        return F.coalesce(matches, F.lit(False))

    def largest(prop: str) -> Column:
        return F.array_max(F.transform(F.filter("wanted", lambda c: c["property"] == prop), lambda c: c["value"]))

    features = [said(p, q).alias(name) for name, (p, q) in flags.items()]
    features += [largest(p).alias(name) for name, p in values.items()]
    rows = found.select(key, *features).distinct().repartition(key).groupBy(key)
    rows = rows.agg(*[F.max(name).alias(name) for name in [*flags, *values]])
    return rows.select(key, *flags, *[entity_id(name).alias(name) for name in values])


def append_features(
    items: DataFrame,
    props: DataFrame,
    flags: Flags | None = None,
    values: Values | None = None,
    key: str = "qitem_id",
    strict: bool = False,
) -> DataFrame:
    """Add claim features to every item: a flag is false and a value null where no claim is found.

    All features come from one pass over the property frame and one join.
    """
    require(items, key)
    flags, values = flags or {}, values or {}
    found = pivot_claims(props, flags, values, key, strict)
    return items.join(found, key, "left").select(
        *items.columns,
        *[F.coalesce(name, F.lit(False)).alias(name) for name in flags],
        *values,
    )


def append_flag(items: DataFrame, props: DataFrame, prop: str, qid: str, name: str, key: str = "qitem_id") -> DataFrame:
    """Add one flag; use ``append_features`` for several at once."""
    return append_features(items, props, flags={name: (prop, qid)}, key=key)


def append_value(items: DataFrame, props: DataFrame, prop: str, name: str, key: str = "qitem_id") -> DataFrame:
    """Add one value; use ``append_features`` for several at once."""
    return append_features(items, props, values={name: prop}, key=key)


def biographies(items: DataFrame, flag: str = "is_human") -> DataFrame:
    """The items whose flag is true."""
    return require(items, flag).where(F.col(flag))


def time_claims(props: DataFrame, lookup: DataFrame) -> DataFrame:
    """The claims about the properties of a lookup (``Property, Label``), with the label."""
    names = require(lookup, "Property", "Label").select(
        F.col("Property").alias("property"), F.col("Label").alias("property_label")
    )
    return require(props, "property").join(names, "property").select(*props.columns, "property_label")


def in_category(items: DataFrame, col: str, lookup: DataFrame, key: str = "QID") -> DataFrame:
    """The items whose ``col`` is listed in a lookup."""
    listed = require(lookup, key).select(F.col(key).alias(col))
    return require(items, col).join(listed, col, "left_semi").select(*items.columns)
