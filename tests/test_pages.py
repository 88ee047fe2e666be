import pytest
from conftest import HISTORY, MONTH, rows, tuples

from lacuna import operators as op
from lacuna import sources

TS = "page_first_edit_timestamp"


@pytest.fixture
def history(spark, history_rows):
    return sources.history(spark, history_rows, MONTH)


@pytest.fixture
def pages(spark, page_rows):
    return sources.pages(spark, page_rows, MONTH)


def test_add_first_edit(spark, history):
    frame = spark.createDataFrame(
        [("b", "enwiki", 1), ("a", "enwiki", 1), ("c", "enwiki", 2), ("d", "enwiki", 8), ("e", "enwiki", 99)],
        "qid string, wiki_db string, page_id bigint",
    )
    found = op.add_first_edit(frame, history)
    assert found.columns == ["page_id", "wiki_db", "qid", TS]
    assert tuples(found) == [
        (1, "enwiki", "a", "2008-11-10 22:23:00"),  # the null is ignored, the smallest row stays
        (2, "enwiki", "c", None),  # known to the history, without a time
        (8, "enwiki", "d", "2009-01-01 01:00:00"),  # the later of two
    ]
    unique = frame.where("qid <> 'b'")
    assert tuples(op.add_first_edit(unique, history, unique=True)) == tuples(found)


def test_first_edit_of(spark, history):
    frame = spark.createDataFrame([("enwiki", 1), ("enwiki", 1), ("frwiki", 9)], "wiki_db string, page_id bigint")
    assert tuples(op.first_edit_of(frame, history)) == [("enwiki", 1, "2008-11-10 22:23:00")]
    assert tuples(op.add_first_edit(frame, history)) == [(1, "enwiki", "2008-11-10 22:23:00")]


def test_totals_count_every_different_time(pages, history):
    found = rows(op.wiki_totals(pages, history), "wiki_db", "year", "month")
    assert [(r["wiki_db"], r["year"], r["month"], r["article_count"], r["cumsum"]) for r in found] == [
        ("enwiki", "2001", "01", 1, 1),  # 2001-01-01 00:00:00.0
        ("enwiki", "2008", "11", 2, 3),
        ("enwiki", "2009", "01", 2, 5),  # page 8 again, page 9 once
        ("enwiki", "bad", "", 1, 6),  # text is cut, not parsed
        ("frwiki", "2001", "02", 1, 1),
    ]


def test_totals_at_the_earliest_time(pages, history):
    found = rows(op.wiki_totals(pages, history, mode="min", count="n", cumsum="s"), "wiki_db")
    assert {(r["wiki_db"], r["year"], r["month"]): (r["n"], r["s"]) for r in found} == {
        ("enwiki", None, None): (1, 1),  # page 2 has no time; null sorts first
        ("enwiki", "2001", "01"): (1, 2),  # fraction cut, bad text skipped
        ("enwiki", "2008", "11"): (2, 4),
        ("enwiki", "2009", "01"): (1, 5),
        ("frwiki", "2001", "02"): (1, 1),
    }


def test_totals_matched_by_page_id_alone(pages, history):
    found = op.wiki_totals(pages, history, mode="min", match_wiki=False)
    assert {(r.wiki_db, r.year, r.month): r.article_count for r in found.collect()}[("enwiki", "2001", "02")] == 1
    both = op.wiki_totals(pages, history, match_wiki=False)
    got = {(r.wiki_db, r.year, r.month): r.article_count for r in both.collect()}
    assert got[("enwiki", "2001", "02")] == got[("frwiki", "2008", "11")] == 1


def test_totals_of_repeated_pages_and_null_times(spark, pages):
    nothing = spark.createDataFrame([("enwiki", 1, None, MONTH)], HISTORY)
    assert op.wiki_totals(pages, nothing).count() == 0
    twice = pages.unionByName(pages)
    once = spark.createDataFrame([("enwiki", 1, "2001-01-01 00:00:00", MONTH)], HISTORY)
    for kind in ({}, {"mode": "min"}, {"match_wiki": False}, {"mode": "min", "match_wiki": False}):
        found = op.wiki_totals(twice, once, **kind).where("wiki_db = 'enwiki'")
        assert tuples(found) == [("enwiki", "2001", "01", 1, 1)]


def test_unknown_mode(pages, history):
    with pytest.raises(ValueError, match="mode"):
        op.wiki_totals(pages, history, mode="max")
