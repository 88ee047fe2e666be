"""Every registered query against its SQL, and the shape of its plan, on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as contract
from analogues.queries import ORACLES, QUERIES
from check import rows_of

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == ["gender", "gender_label", "gender_count", "people_count", "gender_ratio"]
    assert found.count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())


# Python runs in the inference queries only, and there in Arrow batches.
PYTHON = {"decode_images", "detect_summary", "thumbnail_job", "extract_features", "classify_images", "batch_predict"}

# A folder of images is a scan of its own, and so is the test of its files.
FOLDERS = {"ingested_images": 4}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = contract.queries()[name](spark, SF_DIR)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(contract.oracle_sql()[name])
    assert ours == rows_of([d[0] for d in cur.description], cur.fetchall())
    assert ours[1]

    plan = df._jdf.queryExecution().executedPlan().toString()
    nodes = set(re.findall(r"[A-Z]\w+", plan))
    assert not nodes & {"CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"}
    assert plan.split("Initial Plan")[0].count("ArrowEvalPython") == FOLDERS.get(name, name in PYTHON)
