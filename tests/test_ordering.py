"""The plain and the range-spread form agree on skewed data: one key holds most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.operators import ordering as O
from staylens.operators.joins import join_to_unique


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 10 < 7 else f"g{i % 10}", rng.choice([1.0, 2.0, 2.0, rng.random() * 100, None])) for i in range(3000)]
    rows += [(9000, None, 5.0), (9001, None, 7.0)]
    return spark.createDataFrame(rows, "id long, g string, x double")


def rowset(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_quantiles_match_numpy_in_both_forms(skewed):
    specs = {"lo": ("x", 0.0), "q": ("x", 0.37), "m": ("x", 0.5), "hi": ("x", 1.0)}
    plain = O.exact_quantiles(skewed, ["g"], specs, with_count=True)
    spread = O.exact_quantiles(skewed, ["g"], specs, with_count=True, one_task_rows=0)
    a = {r.g: r for r in plain.collect()}
    b = {r.g: r for r in spread.collect()}
    assert a.keys() == b.keys() and None in a
    by = {}
    for r in skewed.collect():
        if r.x is not None:
            by.setdefault(r.g, []).append(r.x)
    for g, xs in by.items():
        for name, (_, p) in specs.items():
            want = float(np.quantile(xs, p))
            assert abs(a[g][name] - want) < 1e-9 and abs(b[g][name] - want) < 1e-9
        assert a[g]["n_m"] == b[g]["n_m"] == len(xs)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert O.exact_quantiles(empty, [], {"m": ("x", .5)}).first().m is None


@pytest.mark.parametrize("limit", [0, 10 ** 6])
def test_dense_keys(skewed, limit):
    got = sorted((r.k, r.id) for r in O.dense_keys(skewed.select("id"), ["id"], "k", limit).collect())
    assert [k for k, _ in got] == list(range(1, 3003)) and [i for _, i in got] == sorted(i for _, i in got)


def test_positions_and_ranks_agree(skewed):
    a = O.positions(skewed, ["g"], ["x", "id"], "p").select("id", "p")
    b = O.positions(skewed, ["g"], ["x", "id"], "p", one_task_rows=0).select("id", "p")
    assert rowset(a) == rowset(b)
    assert rowset(O.tie_ranks(skewed, ["g"], "x")) == rowset(O.tie_ranks(skewed, ["g"], "x", 0))


def test_tie_ranks_share_the_mean(spark):
    df = spark.createDataFrame([(v,) for v in (10, 20, 20, 30)], "x int")
    assert [(r.x, r["rank"]) for r in O.tie_ranks(df, [], "x").orderBy("x").collect()] == [(10, 1.0), (20, 2.5), (30, 4.0)]


def test_running_totals_do_not_depend_on_partitions(skewed):
    known = skewed.filter("x IS NOT NULL AND g IS NOT NULL").withColumn("x", F.round("x", 0))
    a = O.running_totals(known, ["g"], ["id"], {"t": "x"}).select("id", "t")
    b = O.running_totals(known.repartition(7), ["g"], ["id"], {"t": "x"}, 0).select("id", "t")
    assert rowset(a) == rowset(b)


@pytest.mark.parametrize("limit", [100, 10 ** 7])
def test_hot_keys_keep_every_row(spark, skewed, limit):
    from staylens.operators.joins import join_to_unique
    right = spark.createDataFrame([("hot", 1), ("g8", 2)], "g string, v int")
    got = join_to_unique(skewed, right, ["g"], limit)
    assert rowset(got.select("id", "g", "v")) == rowset(skewed.join(right, "g", "left").select("id", "g", "v"))


GAPS = [("a", 1, None), ("a", 2, 2.0), ("a", 3, None), ("a", 4, 2.0), ("b", 1, None), ("b", 2, None), (None, 1, 5.0), (None, 2, None), ("c", 1, 1.0)]


@pytest.mark.parametrize("rows", [GAPS, []])
@pytest.mark.parametrize("group", [["g"], []])
def test_both_forms_agree_on_gaps(spark, rows, group):
    df = spark.createDataFrame(rows, "g string, id long, x double").repartition(5)
    specs = {"median": ("x", .5), "top": ("x", 1.0)}
    plain, spread = (O.exact_quantiles(df, group, specs, True, limit).collect() for limit in (10, 0))
    assert sorted(map(tuple, plain), key=str) == sorted(map(tuple, spread), key=str)
    if not rows and not group:
        assert [tuple(r) for r in spread] == [(None, None, 0, 0)]
    plain, spread = (O.running_totals(df, group, ["g", "id"], {"t": "x"}, limit).select("g", "id", "t").collect() for limit in (10, 0))
    assert sorted(map(tuple, plain), key=str) == sorted(map(tuple, spread), key=str)
    for f in (lambda n: O.tie_ranks(df, group, "x", n), lambda n: O.positions(df, group, ["g", "id"], "at", n).select("g", "id", "at"),
              lambda n: O.dense_keys(df, ["g", "id"], "k", n).select("k", "g", "id")):
        assert sorted(map(tuple, f(10).collect()), key=str) == sorted(map(tuple, f(0).collect()), key=str)


def test_join_keeps_null_keys(spark):
    left = spark.createDataFrame([(1, "p"), (2, "q"), (None, "r"), (None, "s")], "k long, v string")
    right = spark.createDataFrame([(1, "one"), (None, "never")], "k long, name string")
    for hot in (10, 0):
        got = {(r.k, r.v, r.name) for r in join_to_unique(left, right, ["k"], hot).collect()}
        assert got == {(1, "p", "one"), (2, "q", None), (None, "r", None), (None, "s", None)}


def test_aggregate_with_medians_has_one_result_in_both_forms(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", None), (None, 5.0), (None, 7.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    n = [F.count(F.lit(1)).alias("n")]
    for group in (["g"], []):
        for aggs in (n, []):
            one, spread = ([tuple(r) for r in O.aggregate_with_medians(df, group, aggs, {"m": "v"}, at_most=most, one_task_rows=2)
                            .select(*group, *(["n"] if aggs else []), "m").collect()] for most in (2, 6))
            assert sorted(one, key=str) == sorted(spread, key=str)
    assert len(one) == 1 and one[0][-1] == 3.5


def test_spread_sort_leaves_the_columns_of_the_caller(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("_tag"))
    few = O.positions(df, ["g"], ["_tag", "id"], "_r", one_task_rows=10)
    plain = O.positions(df, ["g"], ["_tag", "id"], "_r")
    assert sorted(map(tuple, few.select("id", "_tag", "_r").collect())) == sorted(map(tuple, plain.select("id", "_tag", "_r").collect()))
