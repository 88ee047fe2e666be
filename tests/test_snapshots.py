"""The chain over catalog tables that are partitioned by snapshot."""

import pytest
from conftest import MONTH, NOW, tuples
from test_frames import ARTICLES, ITEMS

from lacuna import lookups, plans
from lacuna import operators as op


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory, entities, link_rows, page_rows, history_rows):
    root = tmp_path_factory.mktemp("catalog")
    frames = {"kb_entity": entities, "kb_link": link_rows, "kb_page": page_rows, "kb_history": history_rows}
    for name, df in frames.items():
        df.write.partitionBy("snapshot").option("path", str(root / name)).mode("overwrite").saveAsTable(name)
    yield plans.Snapshots(spark, *frames)
    for name in frames:
        spark.sql(f"DROP TABLE {name}")


def test_item_and_page_frames(base):
    items = base.item_frame(NOW)
    assert tuples(items) == ITEMS
    assert base.item_frame(NOW, links_in=NOW).where("zero_ill").count() == 1
    listed = op.in_category(base.labels(NOW), "id", lookups.gender_categories(base.spark))
    assert tuples(base.item_frame(NOW, labels=listed)) == ITEMS
    assert tuples(base.page_frame(items, NOW, MONTH)) == ARTICLES
    assert tuples(base.page_frame(items, NOW, MONTH, "frwiki")) == ARTICLES[1:2]


def test_step_by_step(spark, base):
    items = spark.createDataFrame([("Q_plain", "Q6581072"), ("Q_nowhere", "Q101")], "qid string, gender string")
    assert tuples(base.with_label(items, "gender", NOW)) == [("Q_plain", "Q6581072", '"female"')]
    assert base.with_missing_flag(items).where("zero_ill").count() == 0
    assert base.with_missing_flag(items, NOW).where("zero_ill").first().qid == "Q_nowhere"
    linked = base.pages_of_items(items, NOW, "enwiki frwiki")
    assert linked.count() == 3
    assert tuples(base.first_edit_of(linked, MONTH)) == [
        ("enwiki", 1, "2008-11-10 22:23:00"),
        ("enwiki", 8, "2009-01-01 01:00:00"),
        ("frwiki", 1, "2001-02-03 00:00:00"),
    ]
    assert base.with_first_edit(linked, MONTH).columns == ["page_id", "wiki_db", "qid", "page_title", "page_first_edit_timestamp"]


def test_described_items_and_categories(spark, base):
    described = base.described_items(NOW)
    assert described.columns == ["qitem_id", "is_human", "gender", "sexual_orientation"]
    assert described.count() == base.item_ids(NOW).count() == 14
    people = op.biographies(described)
    assert {r.qitem_id: r.gender for r in people.collect()} == {
        "Q_plain": "Q6581072",
        "Q_two": "Q6581097",
        "Q_no_gender": None,
        "Q_unlabelled": "Q100",
        "Q_nowhere": "Q6581097",
    }
    counts = op.category_counts(people, "gender", base.labels(NOW), "gender_label")
    assert [tuple(r) for r in counts.collect()] == [("Q6581097", 2, '"male"'), ("Q6581072", 1, '"female"')]
    several = op.multi_valued(base.properties(NOW), "P21", op.in_category(base.labels(NOW), "id", lookups.gender_categories(spark)))
    assert [tuple(r) for r in several.collect()] == [
        ("Q_two", 2, "Q6581072", '"female"', 1),
        ("Q_two", 2, "Q6581097", '"male"', 1),
    ]


def test_totals(base):
    every = base.page_totals(MONTH)
    assert {r.wiki_db for r in every.collect()} == {"enwiki", "frwiki"}
    assert tuples(base.page_totals(MONTH, "frwiki")) == [("frwiki", "2001", "02", 1, 1)]
    loose = base.page_totals(MONTH, "frwiki", mode="min", match_wiki=False)
    assert tuples(loose) == [("frwiki", "2001", "02", 1, 1)]
    loose = base.page_totals(MONTH, "enwiki", mode="min", match_wiki=False)
    assert ("enwiki", "2001", "02", 1) in [t[:4] for t in tuples(loose)]


def test_share_by_month(base):
    frame = base.page_frame(base.item_frame(NOW), NOW, MONTH)
    found = op.slice_metric(base.article_share_by_month(frame, MONTH), wiki_db="frwiki")
    assert tuples(found) == [("frwiki", "2001", "02", '"female"', 1, 100.0, 1, 100.0)]
    assert base.article_share_by_month(frame, MONTH, until="2001-12").where("wiki_db = 'enwiki'").count() == 1
