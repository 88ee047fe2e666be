from itertools import accumulate

import pytest
from conftest import tuples
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna import operators as op
from lacuna import plans
from lacuna.functions import parse_time, percent, year_month

FEATURES = "wiki_db string, qid string, is_human boolean, gender_label string, date_created string"


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.sampled_from("ab"), st.integers(2001, 2004), st.integers(1, 12)), st.integers(0, 99)))
def test_running_sum_is_cumulative(spark, counts):
    data = [(w, str(y), f"{m:02}", n) for (w, y, m), n in counts.items()]
    found = op.running_sum(spark.createDataFrame(data, "w string, year string, month string, n long"), "n", ["w"])
    expected = []
    for wiki in "ab":
        part = sorted(r for r in data if r[0] == wiki)
        expected += [(*r, s) for r, s in zip(part, accumulate(r[3] for r in part))]
    assert tuples(found) == expected


def test_worked_cumsum(spark):
    data = [("enwiki", "2001", f"{m:02}", n) for m, n in enumerate((5, 12, 31, 32), 1)]
    found = op.running_sum(spark.createDataFrame(data, "wiki_db string, year string, month string, n long"), "n", ["wiki_db"])
    assert [r.cumsum for r in found.orderBy("month").collect()] == [5, 17, 48, 80]


def test_monthly_counts_of_stored_features(spark):
    frame = spark.createDataFrame(
        [
            ("enwiki", "a", True, '"male"', "2001-01-05 00:00:00"),
            ("enwiki", "b", False, '"male"', "2001-01-06 00:00:00"),  # not human, counts
            ("enwiki", "c", True, '"male"', "2001-03-06 00:00:00"),  # no row for the month between
            ("enwiki", "d", True, None, "2001-01-07 00:00:00"),  # the null label is a category
            ("enwiki", "e", True, '"male"', None),  # no date, left out
            ("frwiki", "f", True, '"male"', "2001-02-07 00:00:00"),
        ],
        FEATURES,
    )
    found = plans.number_of_gender_article(frame)
    assert found.columns == ["wiki_db", "year", "month", "gender_label", "article_count", "cumsum"]
    assert tuples(found) == [
        ("enwiki", "2001", "01", '"male"', 2, 2),
        ("enwiki", "2001", "01", None, 1, 1),
        ("enwiki", "2001", "03", '"male"', 1, 3),
        ("frwiki", "2001", "02", '"male"', 1, 1),
    ]
    assert tuples(op.slice_metric(found, wiki_db="enwiki", gender_label=None)) == [("enwiki", "2001", "01", None, 1, 1)]
    assert op.slice_metric(found, gender_label='"male"', month="01").count() == 1
    with pytest.raises(ValueError):
        op.slice_metric(found, nothing=1)


def test_top_k(spark):
    frame = spark.createDataFrame([("a", 3), ("b", 5), ("c", 5), ("d", 1)], "k string, n int")
    assert [r.k for r in op.top_k(frame, "n", 3, ["k"]).collect()] == ["b", "c", "a"]
    plan = op.top_k(frame, "n", 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_time_helpers(spark):
    frame = spark.createDataFrame([("2001-02-03 04:05:06",), ("2001-02-03 04:05:06.0",), ("bad",), (None,)], "t string")
    assert [tuple(r) for r in frame.select(*year_month("t")).collect()][0] == ("2001", "02")
    assert [r[0] and str(r[0]) for r in frame.select(parse_time("t")).collect()] == [
        "2001-02-03 04:05:06",
        "2001-02-03 04:05:06",
        None,
        None,
    ]


def test_percent(spark):
    frame = spark.createDataFrame([(5, 6010), (1, 0), (1, None), (None, 3)], "a long, b long")
    got = [r[0] for r in frame.select(percent("a", "b")).collect()]
    assert got[0] == 5 / 6010 * 100 and got[1:] == [None, None, None]


@pytest.mark.parametrize(
    ("part", "whole", "expected"),
    [
        (1727639, 7280154, 23.73080294730029),
        (345055, 1727639, 19.972633171629024),
        (106, 980, 10.816326530612246),
        (5550576, 7280154, 76.24256300072774),
        (2298460, 5550576, 41.409396069885354),
    ],
)
def test_published_ratios(spark, part, whole, expected):
    frame = spark.createDataFrame([(part, whole)], "a long, b long")
    assert frame.select(percent("a", "b")).first()[0] == expected


@pytest.mark.parametrize(("part", "whole", "expected"), [(5, 6010, 0.083), (12, 427, 2.81), (17, 6439, 0.264)])
def test_published_rounding(spark, part, whole, expected):
    frame = spark.createDataFrame([(part, whole)], "a long, b long")
    assert frame.select(F.round(percent("a", "b"), 3)).first()[0] == expected
