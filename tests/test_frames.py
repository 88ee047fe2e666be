"""From the snapshot tables to the feature frames and the metrics, on the hand-written tables."""

import pytest
from conftest import MONTH, NOW, rows, tuples
from pyspark.sql import functions as F

from lacuna import lookups, plans, sources
from lacuna import operators as op


@pytest.fixture
def items(spark, entities, link_rows):
    return plans.item_features(sources.entities(spark, entities, NOW), link_rows)


def article_frame(spark, items, link_rows, page_rows, history_rows, wikis=None, stage=sources.as_it_is):
    return plans.page_features(
        items,
        sources.links(spark, link_rows, NOW),
        sources.pages(spark, page_rows, MONTH),
        sources.history(spark, history_rows, MONTH),
        wikis,
        stage,
    )


ITEMS = [
    ("Q_gender_only", False, "Q6581097", '"male"', False),
    ("Q_nowhere", True, "Q6581097", '"male"', False),  # linked in another snapshot only
    ("Q_plain", True, "Q6581072", '"female"', False),
    ("Q_two", True, "Q6581097", '"male"', False),
]


def test_item_features(spark, entities, link_rows, items):
    assert items.dtypes == [
        ("qid", "string"),
        ("is_human", "boolean"),
        ("gender", "string"),
        ("gender_label", "string"),
        ("zero_ill", "boolean"),
    ]
    assert tuples(items) == ITEMS
    now = plans.item_features(sources.entities(spark, entities, NOW), sources.links(spark, link_rows, NOW))
    assert {r.qid: r.zero_ill for r in now.collect()} == {r[0]: r[0] == "Q_nowhere" for r in ITEMS}


def test_item_features_with_a_category_list(spark, entities, link_rows):
    dump = sources.entities(spark, entities, NOW)
    labels = op.in_category(op.labels_in(dump), "id", lookups.gender_categories(spark))
    assert tuples(plans.item_features(dump, link_rows, labels)) == ITEMS


def test_item_features_staged(spark, entities, link_rows):
    with sources.Staging(spark) as stage:
        assert tuples(plans.item_features(sources.entities(spark, entities, NOW), link_rows, stage=stage)) == ITEMS
        assert len(stage.paths) == 3  # the items, the genders in use, their labels


def test_labels_in_use_are_broadcast_by_size(spark):
    """Few categories: no shuffle for the label, however hot one of them is."""
    items = sources.staged(spark.range(1_000).selectExpr("id AS n", "if(id % 10 > 0, 'Q1', 'Q2') AS gender"))
    labels = spark.range(100_000).selectExpr("concat('Q', id) AS id", "concat('label ', id) AS label")
    names = op.labels_in_use(labels, items, "gender", sources.staged)
    assert tuples(names) == [("Q1", "label 1"), ("Q2", "label 2")]
    labelled = op.add_label(items, "gender", names)
    text = labelled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
    assert labelled.count() == 1_000


ARTICLES = [
    (1, "enwiki", "Q_plain", True, "Q6581072", '"female"', False, "Ada", "2008-11-10 22:23:00"),
    (1, "frwiki", "Q_plain", True, "Q6581072", '"female"', False, "Ada", "2001-02-03 00:00:00"),
    (2, "enwiki", "Q_two", True, "Q6581097", '"male"', False, "Two", None),
    (8, "enwiki", "Q_plain", True, "Q6581072", '"female"', False, None, "2009-01-01 01:00:00"),
    (9, "enwiki", "Q_two", True, "Q6581097", '"male"', False, None, "2009-01-02 01:00:00"),
]


@pytest.mark.parametrize("staging", [True, False])
def test_page_features(spark, items, link_rows, page_rows, history_rows, staging):
    """The same articles, whether the linked pages are staged or not."""
    with sources.Staging(spark) as stage:
        found = article_frame(spark, items, link_rows, page_rows, history_rows, stage=stage if staging else sources.as_it_is)
        assert len(stage.paths) == 3 * staging  # the linked articles, and the ambiguous of each key
        check_articles(found)


def check_articles(found):
    assert found.dtypes == [
        ("page_id", "bigint"),
        ("wiki_db", "string"),
        ("qid", "string"),
        ("is_human", "boolean"),
        ("gender", "string"),
        ("gender_label", "string"),
        ("zero_ill", "boolean"),
        ("page_title", "string"),
        ("page_first_edit_timestamp", "string"),
    ]
    assert tuples(found) == ARTICLES


def test_copies_of_a_page_make_it_ambiguous(spark, items, link_rows, page_rows, history_rows):
    """Two rows of one page: the page goes, and so does another with the same title."""
    twice = page_rows.unionByName(page_rows.where("wiki_db = 'frwiki' or page_id = 3"))
    found = article_frame(spark, items, link_rows, twice, history_rows)
    assert tuples(found) == [a for a in ARTICLES if a[1] != "frwiki"]


def test_page_features_of_some_wikis(spark, items, link_rows, page_rows, history_rows):
    found = article_frame(spark, items, link_rows, page_rows, history_rows, "frwiki dewiki")
    assert tuples(found) == ARTICLES[1:2]


def test_pages_without_items_column(spark, page_rows):
    with pytest.raises(ValueError, match="qid"):
        plans.page_features(page_rows, page_rows, page_rows, page_rows)


def test_metrics(spark, items, link_rows, page_rows, history_rows):
    articles = article_frame(spark, items, link_rows, page_rows, history_rows)
    pages, history = sources.pages(spark, page_rows, MONTH), sources.history(spark, history_rows, MONTH)

    share = plans.number_of_gender_item(items)
    assert sum(r.gender_count for r in share.collect()) == items.where("is_human").count() == 3

    coverage = plans.number_of_gender_article_overall(articles, items)
    assert tuples(coverage) == [
        ("enwiki", "Q6581072", '"female"', 2, 1, 200.0),
        ("enwiki", "Q6581097", '"male"', 2, 2, 100.0),
        ("frwiki", "Q6581072", '"female"', 1, 1, 100.0),
    ]

    monthly = plans.number_of_gender_article_by_month(articles, pages, history)
    female = op.slice_metric(monthly, wiki_db="enwiki", gender_label='"female"')
    assert [(r.year, r.month, r.article_count, r["cumsum"]) for r in female.orderBy("year").collect()] == [
        ("2008", "11", 1, 1),
        ("2009", "01", 1, 2),
    ]
    # Articles without a time are in the coverage and not in the monthly counts.
    by_month = monthly.agg(F.sum("article_count")).first()[0]
    assert by_month == 4 < sum(r.article_count for r in coverage.collect())

    steps = rows(monthly.where("gender_label is not null"), "wiki_db", "gender_label", "year", "month")
    for before, after in zip(steps, steps[1:]):
        if (before["wiki_db"], before["gender_label"]) == (after["wiki_db"], after["gender_label"]):
            assert after["cumsum"] == before["cumsum"] + after["article_count"]

    profile = op.profile(items, nulls=["gender", "gender_label"], distinct=["gender"], flags=["is_human", "zero_ill"])
    assert profile.first().asDict() == {
        "rows": 4,
        "gender_nulls": 0,
        "gender_label_nulls": 0,
        "gender_distinct": 2,
        "is_human_true": 3,
        "is_human_false": 1,
        "zero_ill_true": 0,
        "zero_ill_false": 4,
    }


def test_hot_gender(spark):
    """Nine of ten items share one gender: its partition is split, also below an aggregate on it."""
    items = spark.range(50_000).select(
        F.concat(F.lit("Q"), "id").alias("qid"),
        F.when(F.col("id") % 10 > 0, "Q6581097").otherwise(F.concat(F.lit("G"), F.col("id") % 7)).alias("gender"),
    )
    labels = spark.createDataFrame([("Q6581097", "male"), *[(f"G{i}", f"g{i}") for i in range(7)]], "id string, label string")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        labelled = op.add_label(items, "gender", labels, "gender_label")
        counted = labelled.groupBy("gender", "gender_label").agg(F.count("*").alias("n"), F.max("qid").alias("last"))
        found = {r.gender: r.n for r in counted.collect()}
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert found["Q6581097"] == 45_000 and sum(found.values()) == 50_000
