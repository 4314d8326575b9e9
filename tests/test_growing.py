import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.operators.growing import GrowingProfile
from staylens.operators.ledger import Ledger

SCHEMA = "k long, v double, t string, none double"


@pytest.fixture
def profile(spark, tmp_path):
    return GrowingProfile(spark, str(tmp_path / "state"), Ledger(spark, str(tmp_path / "ledger")), "table")


def test_second_file_is_merged_within_the_stated_error(spark, profile):
    rng = np.random.default_rng(3)
    v = np.r_[rng.normal(0, 1, 6000), rng.normal(9, 2, 6000)]
    rows = [(int(i % 5000), float(x), None if i % 4 == 0 else f"w{i % 700}", None) for i, x in enumerate(v)]
    assert profile.report().count() == 0
    assert profile.add(spark.createDataFrame(rows[:6000], SCHEMA), "one.csv", "h1")
    assert profile.add(spark.createDataFrame(rows[6000:], SCHEMA), "two.csv", "h2")
    assert not profile.add(spark.createDataFrame(rows[:6000], SCHEMA), "one.csv", "h1")  # delivered again
    got = {r.column_name: r for r in profile.report().collect()}
    assert got["v"].row_count == 12000 and got["t"].null_count == 3000 and got["none"].null_count == 12000
    assert got["v"].min == v.min() and got["v"].max == v.max() and got["v"].mean == pytest.approx(v.mean(), abs=1e-4)
    assert abs(got["k"].unique_count - 5000) < 150 and abs(got["t"].unique_count - len({r[2] for r in rows} - {None})) < 21
    for name, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        assert abs((v <= got["v"][name]).mean() - p) < 0.005
    assert got["none"].median is None and got["t"].median is None and got["none"].unique_count == 0


def test_failed_run_leaves_the_state_and_new_columns_join_it(spark, profile):
    profile.add(spark.createDataFrame([(1, 2.0)], "a long, b double"), "one", "h1")
    broken = spark.createDataFrame([(1, 2.0)], "a long, b double").withColumn("b", F.raise_error(F.lit("bad file")).cast("double"))
    with pytest.raises(Exception):
        profile.add(broken, "two", "h2")
    assert {r.column_name: r.row_count for r in profile.report().collect()} == {"a": 1, "b": 1}
    profile.add(spark.createDataFrame([(float("nan"), "x")], "b double, `c.d` string"), "three", "h3")
    got = {r.column_name: r for r in profile.report().collect()}
    assert (got["a"].row_count, got["b"].row_count, got["c.d"].unique_count) == (1, 2, 1)
    assert got["b"].median == 2.0 and got["b"]["max"] == 2.0
    profile.add(spark.createDataFrame([], "a long, b double"), "four", "h4")
    assert {r.column_name: r.row_count for r in profile.report().collect()} == {"a": 1, "b": 2, "c.d": 1}
