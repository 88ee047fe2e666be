import numpy as np
import pandas as pd
import pytest
from conftest import rows

from pyspark.sql import functions as F

from lacuna import operators as op
from lacuna.operators import quality


def test_profile(spark):
    frame = spark.createDataFrame(
        [("a", True, "x"), ("b", False, None), ("c", None, "x"), ("d", True, "y")], "k string, f boolean, g string"
    )
    assert rows(op.profile(frame, nulls=["g", "k"], distinct=["g", "k"], flags=["f"])) == [
        {"rows": 4, "g_nulls": 1, "k_nulls": 0, "g_distinct": 3, "k_distinct": 4, "f_true": 2, "f_false": 1}
    ]


def test_profile_of_nothing(spark):
    frame = spark.createDataFrame([], "g string, f boolean")
    assert rows(op.profile(frame, ["g"], ["g"], ["f"])) == [
        {"rows": 0, "g_nulls": 0, "g_distinct": 0, "f_true": 0, "f_false": 0}
    ]


def described(df):
    return {r["column"]: r for r in rows(df)}


CASES = {
    "even": lambda rng, n: rng.permutation(n).astype(float),
    "hot": lambda rng, n: np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 50, n)),
    "tail": lambda rng, n: np.exp(rng.normal(0, 6, n)),
    "two": lambda rng, n: rng.integers(0, 2, n).astype(float),
}


@pytest.mark.parametrize("bits", [(22, 21, 21), (64,), (1, 31, 32), (30, 34)])
@pytest.mark.parametrize("n", [1, 2, 5, 101, 3000])
def test_summary_equals_pandas(spark, n, bits):
    rng = np.random.default_rng(n)
    data = pd.DataFrame({name: make(rng, n) for name, make in CASES.items()})
    found = described(op.summary_stats(spark.createDataFrame(data), list(CASES), bits=bits))
    expected = data.describe()
    for name in CASES:
        for stat in expected.index:
            got, want = found[name][stat], expected[name][stat]
            assert (got is None and np.isnan(want)) or got == pytest.approx(want, rel=1e-9, abs=1e-12), (name, stat)


def test_keys_stand_in_the_order_of_doubles():
    values = np.array([-np.inf, -1e300, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1e300, np.inf, np.nan])
    keys = quality._key(values)
    assert (np.diff(keys) >= 0).all() and keys[4] == keys[5] and len(set(keys.tolist())) == len(values) - 1
    back = np.array([quality._value(int(k)) for k in keys])
    assert np.array_equal(back, values, equal_nan=True)
    assert quality._key(np.array([-np.nan]))[0] == keys[-1]


def test_rows_sent_do_not_grow_with_the_input(spark):
    """Ten times the rows, about as many prefixes: on the first scan those of the values' range, later
    those inside the few prefixes that hold a rank."""
    sizes = {}
    for n in (20_000, 200_000):
        frame = spark.range(n).selectExpr("cast(1 + id % 977 / 977.0 as double) AS c0")
        first = quality._prefix_counts(frame, {(0, 0): None}, 0, 22)
        held = {(0, quality._key(np.array([1.5]))[0] >> 42): None}
        sizes[n] = first.count(), quality._prefix_counts(frame, held, 22, 21).count()
    assert sizes[20_000] == sizes[200_000] and sizes[20_000][0] <= 1_024 and sizes[20_000][1] <= 2


def test_one_scan_for_each_step(spark, monkeypatch):
    scans = []
    real = quality._prefix_counts
    monkeypatch.setattr(quality, "_prefix_counts", lambda *a: scans.append(a[2:]) or real(*a))
    frame = spark.createDataFrame([(float(k),) for k in range(101)], "x double")
    found = described(op.summary_stats(frame, ["x"], [0.25, 0.5, 0.75, 0.999]))
    assert [found["x"][q] for q in ("25%", "50%", "75%", "99.9%")] == [25.0, 50.0, 75.0, pytest.approx(99.9)]
    assert scans == [(0, 22), (22, 21), (43, 21)]


def test_summary_of_odd_values(spark):
    rows = [(x,) for x in (float("nan"), float("inf"), -0.0, 0.0, None, -1.0)]
    found = described(op.summary_stats(spark.createDataFrame(rows, "x double"), ["x"], [0.0, 0.25, 0.5, 0.75, 1.0]))["x"]
    assert [found[q] for q in ("0%", "25%", "50%", "75%")] == [-1.0, 0.0, 0.0, float("inf")]
    assert found["count"] == 5 and np.isnan(found["100%"]) and np.isnan(found["max"])


def test_summary_of_nothing(spark):
    found = described(op.summary_stats(spark.createDataFrame([], "x double"), ["x"]))["x"]
    assert found["count"] == 0 and found["50%"] is None
    with pytest.raises(ValueError, match="64"):
        op.summary_stats(spark.range(1), ["id"], bits=(8, 8))


def test_summary_skips_nulls_and_shows_empty_columns(spark):
    frame = spark.createDataFrame([(1, None), (2, None), (None, None), (4, None)], "a int, b double")
    found = described(op.summary_stats(frame, ["a", "b"], probabilities=[0.5]))
    assert found["a"] == {"column": "a", "count": 3, "mean": 7 / 3, "std": pytest.approx(1.5275252), "min": 1.0, "50%": 2.0, "max": 4.0}
    assert found["b"] == {"column": "b", "count": 0, "mean": None, "std": None, "min": None, "50%": None, "max": None}


def test_summary_needs_its_columns(spark):
    with pytest.raises(ValueError, match="nope"):
        op.summary_stats(spark.range(1), ["nope"])
