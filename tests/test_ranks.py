import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.operators import ranks


def plain_ranks(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_equal_values_across_ranges_share_their_mean_rank(spark):
    rng = np.random.default_rng(1)
    v = np.where(rng.random(900) < 0.4, 7.0, rng.integers(0, 40, 900)).astype(float)  # one value is in several ranges
    w = np.r_[np.full(500, 3.0), rng.normal(0, 1, 400)]
    both = [(i, 0, float(x)) for i, x in enumerate(v)] + [(i, 1, float(x)) for i, x in enumerate(w)]
    got = ranks.average_ranks(spark.createDataFrame(both, "id long, measure int, value double"), len(both), 0).toPandas()
    for m, want in ((0, plain_ranks(v)), (1, plain_ranks(w))):
        mine = got[got.measure == m].sort_values("id")
        assert mine["id"].tolist() == list(range(900)) and np.allclose(mine["rank"], want)


@pytest.mark.parametrize("few, one_task", [(ranks.FEW_VALUES, 0), (0, 0), (0, 10_000)])  # by lookup, by ranges, by a window
def test_gaps_constants_and_special_values(spark, few, one_task):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 300).astype(float), rng.integers(0, 5, 300).astype(float)
    rows = [(float(x), None if i % 7 == 0 else float(y), 4.0, None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, k double, none double")
    pairs = [("a", "b"), ("a", "k"), ("a", "none"), ("b", "k")]
    got = {(r.column_a, r.column_b): (r.n, r.rho) for r in ranks.rank_correlations(df, pairs, few, one_task).collect()}
    known = np.arange(300) % 7 != 0
    want = np.corrcoef(plain_ranks(a[known]), plain_ranks(b[known]))[0, 1]
    assert got[("a", "b")] == (known.sum(), pytest.approx(want))
    assert got[("a", "k")] == (300, None) and got[("a", "none")] == (0, None)
    empty = ranks.rank_correlations(df.limit(0), [("a", "b")], few, one_task).collect()
    assert [(r.n, r.rho) for r in empty] == [(0, None)]
    odd = spark.createDataFrame([(float("nan"), 1.0), (float("nan"), 2.0), (-0.0, 3.0), (0.0, 4.0)], "a double, b double")
    got = ranks.average_ranks(odd.select(F.col("b").cast("long").alias("id"), F.lit(0).alias("measure"), F.col("a").alias("value")), 4, one_task)
    assert {r.id: r["rank"] for r in got.collect()} == {1: 3.5, 2: 3.5, 3: 1.5, 4: 1.5}


def test_nothing_is_joined_on_a_value(spark, capsys):
    df = spark.range(1000).select((F.col("id") % 3).cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    for few in (100, 0):
        ranks.rank_correlations(df, [("a", "b")], few, 0).explain()
        assert "SortMergeJoin" not in capsys.readouterr().out
