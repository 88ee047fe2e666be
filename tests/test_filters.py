import pytest
from conftest import tuples
from pyspark.sql import functions as F

from lacuna import operators as op
from lacuna import sources

KEY = ["page_id", "wiki_db"]


@pytest.fixture(scope="module")
def keys(spark):
    frame = spark.range(0, 20_000, 7).selectExpr("id AS page_id", "concat('w', id % 3) AS wiki_db")
    return frame.unionByName(spark.createDataFrame([(None, "w"), (5, None)], "page_id bigint, wiki_db string"))


@pytest.fixture(scope="module")
def others(spark):
    return spark.range(20_000).selectExpr("id AS page_id", "concat('w', id % 3) AS wiki_db")


@pytest.mark.parametrize("most_bits", [1 << 26, 1 << 12])
def test_no_match_is_lost(keys, others, most_bits):
    """Also with a filter so full that it lets nearly all rows through."""
    passed = others.where(op.may_be_in(keys, KEY, most_bits=most_bits)(*KEY))
    assert tuples(passed.join(keys, KEY)) == tuples(others.join(keys, KEY))
    assert passed.count() < (0.3 if most_bits > 1 << 20 else 0.8) * others.count()


def test_empty_keys_let_nothing_through(keys, others):
    assert others.where(op.may_be_in(keys.where("false"), KEY)(*KEY)).count() == 0


@pytest.mark.parametrize("copies", [None, "n"])
def test_what_may_repeat(spark, copies):
    frame = spark.range(5_000).selectExpr("concat('t', id % 4900) AS title", "1 AS n")
    if copies:
        frame = frame.dropDuplicates(["title"]).withColumn("n", F.when(F.col("title") == "t17", 2).otherwise(1))
    passed = frame.where(op.may_repeat(frame, ["title"], copies))
    number = F.count("*") if copies is None else F.sum(copies)
    repeated = frame.groupBy("title").agg(number.alias("k")).where("k > 1").select("title")
    assert repeated.count() == (1 if copies else 100)
    assert tuples(passed.join(repeated, "title", "left_semi")) == tuples(frame.join(repeated, "title", "left_semi"))
    assert passed.count() < 0.3 * frame.count()


@pytest.mark.parametrize("candidates", [False, True])
def test_ambiguous_rows_go_with_and_without_the_filter(spark, candidates):
    frame = spark.range(1_000).selectExpr("id AS page_id", "'w' AS wiki_db", "if(id > 5, concat('t', id % 990), null) AS page_title")
    with sources.Staging(spark) as stage:
        found = op.drop_ambiguous(stage(frame), stage=stage, candidates=candidates)
        assert tuples(found) == tuples(op.drop_ambiguous(frame))


def test_the_filter_runs_in_the_scan(spark, keys, others, tmp_path):
    """It is a filter below the exchange, and the bitmap a subquery of bounded size."""
    others.write.parquet(str(tmp_path / "others"))
    read = spark.read.parquet(str(tmp_path / "others"))
    found = read.where(op.may_be_in(keys, KEY)(*KEY)).groupBy(*KEY).count()
    text = found._jdf.queryExecution().executedPlan().toString()
    below = text[text.index("Exchange hashpartitioning") :]
    assert "Subquery" in below.split("FileScan")[0] and "Python" not in text
