import pytest
from conftest import MONTH, tuples

from lacuna import operators as op
from lacuna import plans

ITEM = "qid string, is_human boolean, gender string, gender_label string, zero_ill boolean"
M, F_ = ("Q6581097", '"male"'), ("Q6581072", '"female"')


@pytest.fixture
def items(spark):
    return spark.createDataFrame(
        [
            ("a", True, *M, True),
            ("b", True, *M, False),
            ("c", True, *M, True),
            ("d", True, *F_, False),
            ("e", False, *F_, True),  # not human
            ("f", True, None, None, True),  # no gender
        ],
        ITEM,
    )


PAGE = ITEM + ", wiki_db string, page_id bigint, page_first_edit_timestamp string"


@pytest.fixture
def page_frame(spark):
    return spark.createDataFrame(
        [
            ("a", True, *M, False, "enwiki", 1, "2001-01-05 00:00:00"),
            ("b", True, *M, False, "enwiki", 2, "2001-03-05 00:00:00"),
            ("d", True, *F_, False, "enwiki", 3, "2001-03-06 00:00:00"),
            ("d", True, *F_, False, "frwiki", 3, None),  # counts for coverage, not by month
            ("e", False, *F_, False, "enwiki", 4, "2001-03-06 00:00:00"),  # not human
            ("x", True, "Q9", '"other"', False, "enwiki", 5, "2001-05-06 00:00:00"),  # no such item
        ],
        PAGE,
    )


def test_share(items):
    found = [tuple(r) for r in plans.number_of_gender_item(items).collect()]
    assert found == [
        (*M, 3, 5, 60.0),
        (None, None, 1, 5, 20.0),
        (*F_, 1, 5, 20.0),
    ]


def test_share_of_nothing(items):
    assert op.share_of_total(items.where("qid = ''"), ["gender"]).collect() == []


def test_share_aggregates_the_input_once(items):
    df = op.share_of_total(items, ["gender"])
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_coverage(items, page_frame):
    found = plans.number_of_gender_article_overall(page_frame, items)
    assert found.columns == ["wiki_db", "gender", "gender_label", "article_count", "gender_count", "article_ratio"]
    assert [tuple(r) for r in found.collect()] == [
        ("enwiki", *M, 2, 3, 2 / 3 * 100),
        ("enwiki", *F_, 1, 1, 100.0),
        ("frwiki", *F_, 1, 1, 100.0),
    ]


def test_zero_link_ratio(items):
    found = plans.number_of_gender_zero_ill(items)
    assert found.columns == ["gender", "gender_label", "zero_ill_count", "gender_count", "zero_ill_ratio"]
    # Female items all have pages and the null gender matches nothing: both are absent.
    assert [tuple(r) for r in found.collect()] == [(*M, 2, 3, 2 / 3 * 100)]


@pytest.fixture
def totals(spark):
    return spark.createDataFrame(
        [
            ("enwiki", "2001", "01", 10, 10),
            ("enwiki", "2001", "02", 5, 15),  # nothing of ours in this month
            ("enwiki", "2001", "03", 4, 19),
            ("enwiki", None, None, 1, 20),
        ],
        "wiki_db string, year string, month string, wp_count long, wp_cumsum long",
    )


def test_monthly_share(page_frame, totals):
    found = op.monthly_share(op.biographies(page_frame), totals)
    assert found.columns == [
        "wiki_db",
        "year",
        "month",
        "gender_label",
        "article_count",
        "monthly_article_ratio",
        "cumsum",
        "article_ratio",
    ]
    assert tuples(found) == [
        ("enwiki", "2001", "01", '"male"', 1, 10.0, 1, 10.0),
        ("enwiki", "2001", "02", None, None, None, None, None),
        ("enwiki", "2001", "03", '"female"', 1, 25.0, 1, 1 / 19 * 100),
        ("enwiki", "2001", "03", '"male"', 1, 25.0, 2, 2 / 19 * 100),
        ("enwiki", "2001", "05", '"other"', 1, None, 1, None),  # a month the totals lack
        ("enwiki", None, None, None, None, None, None, None),
    ]
    assert op.monthly_share(op.biographies(page_frame), totals, until="2001-02").count() == 3


def test_by_month_over_page_tables(spark, page_frame):
    pages = spark.createDataFrame([("enwiki", i, "t") for i in range(1, 6)], "wiki_db string, page_id bigint, page_title string")
    history = spark.createDataFrame(
        [("enwiki", i, f"2001-03-{i:02} 00:00:00", MONTH) for i in range(1, 5)],
        "wiki_db string, page_id bigint, page_first_edit_timestamp string, snapshot string",
    )
    found = plans.number_of_gender_article_by_month(page_frame, pages, history)
    got = {(r.month, r.gender_label): (r.monthly_article_ratio, r.article_ratio) for r in found.collect()}
    assert got[("03", '"male"')] == (25.0, 50.0)


SERIES = "wiki_db string, year string, month string, gender_label string, article_count long, cumsum long"


def test_monthly_pct(spark):
    series = spark.createDataFrame(
        [
            ("enwiki", "2001", "02", '"male"', 12, 17),
            ("enwiki", "2001", "01", '"male"', 5, 5),
            ("enwiki", "2001", "09", '"male"', 1, 18),  # no total
        ],
        SERIES,
    )
    totals = spark.createDataFrame(
        [("enwiki", "2001", "01", 6010, 6012), ("enwiki", "2001", "02", 427, 6439)],
        "wiki_db string, year string, month string, article_count long, cumsum long",
    )
    found = op.monthly_pct(series, totals)
    assert found.columns == [
        "wiki_db", "year", "month", "gender_label", "article_count", "cumsum", "wp_count", "wp_cumsum",
        "monthly_pct", "accumulated_pct",
    ]
    assert [(r.month, r.monthly_pct, r.accumulated_pct) for r in found.collect()] == [("01", 0.083, 0.083), ("02", 2.81, 0.264)]
