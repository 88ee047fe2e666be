"""The stored category lists and the names of the classifier's features.

They are data the results depend on, kept as they are published, in their natural order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Sex or gender (P21) categories, label and entity.
GENDER_CATEGORIES = (
    ("male", "Q6581097"),
    ("female", "Q6581072"),
    ("intersex", "Q1097630"),
    ("transgender female", "Q1052281"),
    ("transgender male", "Q2449503"),
    ("non-binary", "Q48270"),
    ("fa'afafine", "Q1399232"),
    ("māhū", "Q3277905"),
    ("kathoey", "Q746411"),
    ("fakaleitī", "Q350374"),
    ("hijra", "Q660882"),
    ("male organism", "Q44148"),
    ("female organism", "Q43445"),
    ("androgyny", "Q207959"),
    ("two-spirit", "Q301702"),
    ("transmasculine", "Q27679766"),
    ("transfeminine", "Q27679684"),
    ("muxe", "Q3177577"),
    ("intersex organism", "Q28873047"),
    ("agender", "Q505371"),
    ("genderqueer", "Q12964198"),
    ("genderfluid", "Q18116794"),
    ("neutrois", "Q1289754"),
    ("eunuch", "Q179294"),
    ("pangender", "Q7130936"),
    ("cogenitor", "Q64017034"),
    ("neutral sex", "Q52261234"),
    ("hermaphroditism", "Q16674976"),
    ("cisgender female", "Q15145779"),
    ("cisgender male", "Q15145778"),
    ("third gender", "Q48279"),
    ("X-gender", "Q96000630"),
    ("demiboy", "Q93954933"),
    ("demigirl", "Q93955709"),
    ("bigender", "Q859614"),
    ("transgender person", "Q189125"),
    ("travesti", "Q17148251"),
    ("akava'ine", "Q4700377"),
    ("assigned female at birth", "Q56315990"),
    ("assigned male at birth", "Q25388691"),
)

# Sexual orientation (P91) categories, label and entity.
SEXUAL_ORIENTATION_CATEGORIES = (
    ("heterosexuality", "Q1035954"),
    ("homosexuality", "Q6636"),
    ("bisexuality", "Q43200"),
    ("gay", "Q592"),
    ("lesbianism", "Q6649"),
    ("non-heterosexuality", "Q339014"),
    ("asexuality", "Q724351"),
    ("gray asexuality", "Q8354594"),
    ("aromanticism", "Q52746927"),
    ("pansexuality", "Q271534"),
    ("demisexuality", "Q23912283"),
    ("sapiosexuality", "Q20011275"),
    ("Polysexuality", "Q2094204"),
    ("gynephilia", "Q1558475"),
    ("androphilia", "Q513896"),
)

# Properties that hold a date, property and label.
TIME_PROPERTIES = (
    ("P569", "date of birth"),
    ("P570", "date of death"),
    ("P580", "start time"),
    ("P582", "end time"),
    ("P577", "publication date"),
    ("P571", "inception"),
    ("P1619", "date of official opening"),
    ("P576", "dissolved, abolished or demolished"),
    ("P1191", "date of first performance"),
    ("P813", "retrieved"),
    ("P1249", "time of earliest written record"),
    ("P575", "time of discovery or invention"),
)

# The classifier's features, in the order of its weights.
CLASSIFIER_FEATURES = (
    "category_crawling_territories",
    "category_crawling_territories_level",
    "language_weak_wd",
    "affiliation_wd",
    "has_part_wd",
    "num_inlinks_from_CCC",
    "num_outlinks_to_CCC",
    "percent_inlinks_from_CCC",
    "percent_outlinks_to_CCC",
    "other_ccc_language_strong_wd",
    "other_ccc_created_by_wd",
    "other_ccc_part_of_wd",
    "other_ccc_language_weak_wd",
    "other_ccc_affiliation_wd",
    "other_ccc_has_part_wd",
)


def lookup_frame(spark: SparkSession, rows, names: tuple[str, str]) -> DataFrame:
    """A two-column text lookup. Catalyst knows its size and broadcasts it unasked."""
    first, second = zip(*rows)
    return spark.createDataFrame(pa.table({names[0]: pa.array(first), names[1]: pa.array(second)}))


def gender_categories(spark: SparkSession) -> DataFrame:
    return lookup_frame(spark, GENDER_CATEGORIES, ("Label", "QID"))


def sexual_orientation_categories(spark: SparkSession) -> DataFrame:
    return lookup_frame(spark, SEXUAL_ORIENTATION_CATEGORIES, ("Label", "QID"))


def time_properties(spark: SparkSession) -> DataFrame:
    return lookup_frame(spark, TIME_PROPERTIES, ("Property", "Label"))
