"""Tests against closed forms, numpy and brute force on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.functions import tails
from staylens.operators import stats as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.normal(50, 10, 200)] + [("b", float(x)) for x in rng.normal(80, 10, 200)] + [
        ("c", float(x)) for x in np.round(rng.exponential(100, 300))]
    return spark.createDataFrame(rows, "g string, x double")


def values(df, g):
    return np.array([r.x for r in df.filter(F.col("g") == g).collect()])


def test_tails():
    assert abs(tails.normal_sf(1.959963985) - 0.025) < 1e-9
    assert abs(tails.t_sf(2.0, 10) - 0.036694017) < 1e-8 and abs(tails.t_sf(-2.0, 10) - 0.963305983) < 1e-8
    assert abs(tails.f_sf(3.0, 2, 20) - 0.072537746) < 1e-6
    assert abs(tails.chi2_sf(5.991464547, 2) - 0.05) < 1e-9 and abs(tails.chi2_sf(20.0, 3) - 0.000169742) < 1e-8
    assert abs(tails.t_quantile(0.975, 10) - 2.228138852) < 1e-6


def test_normality(data):
    got = {r.g: r for r in S.normality(data, ["g"], "x").collect()}
    assert got["a"].is_normal and got["b"].is_normal and not got["c"].is_normal
    few = data.limit(5)
    assert S.normality(few, [], "x").first().test == "Insufficient data"


def test_cohens_d(data):
    a, b = values(data, "a"), values(data, "b")
    want = (a.mean() - b.mean()) / math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2)
    r = S.cohens_d(data, "g", "x", "a", "b").first()
    assert abs(r.d - want) < 1e-9 and r.magnitude == "large"


def test_rank_sum_by_brute_force(data):
    a, c = values(data, "a"), values(data, "c")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in c)
    r = S.rank_sum(data, "g", "x", "a", "c").first()
    assert r.statistic == u and abs(r.effect - (1 - 2 * u / (len(a) * len(c)))) < 1e-12


def test_pairwise_counts(data):
    got = {(r.group_a, r.group_b): r for r in S.posthoc(data, "g", "x").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")} and got[("a", "b")].is_significant
    with pytest.raises(ValueError):
        S.pairwise_rank_sums(data, "g", "x", max_groups=2)


def test_two_groups_choose_the_test(data):
    t = S.two_group_test(data, "g", "x", "a", "b").first()
    assert t.test == "Welch's t-test" and t.is_significant
    u = S.two_group_test(data, "g", "x", "a", "c").first()
    assert u.test == "Mann-Whitney U"
    one_sided = S.two_group_test(data, "g", "x", "a", "b", alternative="greater").first()
    assert one_sided.p_value > 0.99


def test_kruskal_by_ranks(data):
    xs = [(r.g, r.x) for r in data.collect()]
    order = sorted(x for _, x in xs)
    rank = {v: (2 * order.index(v) + order.count(v) + 1) / 2 for v in set(order)}
    n, h = len(xs), 0.0
    for g in "abc":
        mine = [rank[x] for k, x in xs if k == g]
        h += sum(mine) ** 2 / len(mine)
    ties = sum(order.count(v) ** 3 - order.count(v) for v in set(order))
    want = (12 / (n * (n + 1)) * h - 3 * (n + 1)) / (1 - ties / (n ** 3 - n))
    assert abs(S.kruskal_wallis(data, "g", "x").first().statistic - want) < 1e-8


def test_multi_group(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(x)) for g, m in (("p", 10), ("q", 20), ("r", 30)) for x in rng.normal(m, 2, 100)]
    got = S.multi_group_test(spark.createDataFrame(rows, "g string, x double"), "g", "x", "H")
    row = got["test"].first()
    assert row.is_significant and row.magnitude == "large" and got["posthoc"].count() == 3


def test_signed_rank_by_hand(spark):
    rng = random.Random(5)
    pairs = [(float(rng.randint(0, 20)), float(rng.randint(0, 18))) for _ in range(60)]
    d = [a - b for a, b in pairs if a != b]
    size = sorted(abs(x) for x in d)
    rank = {v: (2 * size.index(v) + size.count(v) + 1) / 2 for v in set(size)}
    plus, minus = sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0)
    df = spark.createDataFrame(pairs, "a double, b double")
    r = S.signed_rank(df, "a", "b").first()
    assert (r.plus, r.minus, r.n) == (plus, minus, len(d))
    same = spark.createDataFrame([(1.0, 1.0)] * 20, "a double, b double")
    assert S.paired_test(same, "a", "b").first().p_value == 1.0


def test_spearman_pairwise_complete(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 5.0), (3.0, 4.0, 6.0), (4.0, 3.0, 6.0), (None, 9.0, 1.0)]
    got = {(r.column_a, r.column_b): (r.n, r.rho) for r in S.spearman(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == (4, pytest.approx(0.6)) and got[("a", "c")][0] == 3


def test_regression_matches_numpy(spark):
    rng = np.random.default_rng(9)
    x1, x2 = rng.normal(0, 1, 500), rng.normal(5, 2, 500)
    y = 10 + 3 * x1 - 2 * x2 + rng.normal(0, 1, 500)
    df = spark.createDataFrame([(float(a), float(b), 1.0, float(c)) for a, b, c in zip(x1, x2, y)], "x1 double, x2 double, k double, y double")
    out = S.ols(df, ["x1", "x2", "k"], "y", log_target=False)
    design = np.column_stack([np.ones(500), x1, x2])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(rss[0] / 497 * np.diag(np.linalg.inv(design.T @ design)))
    got = {r.feature: r for r in out["coefficients"].collect()}
    for name, b, e in zip(["const", "x1", "x2"], beta, se):
        assert abs(got[name].coefficient - b) < 1e-9 and abs(got[name].std_error - e) < 1e-9
    fit = out["fit"].first()
    assert fit.r_squared > 0.7 and fit.dropped_columns == "k" and fit.n_observations == 500
    assert fit.heteroscedasticity_p > 0.001 and fit.residual_normality_p > 0.001


def test_vif_of_a_near_copy(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, 200)
    df = spark.createDataFrame([(float(v), float(v + e), float(z)) for v, e, z in zip(a, rng.normal(0, .05, 200), rng.normal(0, 1, 200))], "a double, b double, c double")
    got = {r.feature: r for r in S.vif(df, ["a", "b", "c"]).collect()}
    assert got["a"].vif > 50 and got["a"].flag == "SEVERE" and got["c"].vif < 2


def test_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(4)
    xs = rng.normal(100, 15, 500)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id long, x double")
    r = S.bootstrap_mean(df, [], "x", "id", resamples=1000).first()
    half = 1.96 * xs.std(ddof=1) / math.sqrt(500)
    assert r.ci_lower < xs.mean() < r.ci_upper and abs((r.ci_upper - r.ci_lower) / 2 - half) < 0.25 * half
    t = S.mean_ci(df, [], "x").first()
    assert abs((t.ci_upper - t.ci_lower) / 2 - half) < 0.02 * half


def test_corrections(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "test string, p_value double")
    def got(m):
        return {r.test: round(r.p_adjusted, 6) for r in S.adjust_p(df, method=m).collect()}
    assert got("bonferroni") == {"a": 0.04, "b": 0.16, "c": 0.12, "d": 0.02}
    assert got("holm") == {"a": 0.03, "b": 0.06, "c": 0.06, "d": 0.02}
    assert got("fdr_bh") == {"a": 0.02, "b": 0.04, "c": 0.04, "d": 0.02}


def test_chi_square_with_empty_cell(spark):
    rows = [("x", "p")] * 10 + [("x", "q")] * 5 + [("y", "q")] * 7 + [("z", "p")] * 3 + [("z", "q")] * 4
    o = np.array([[10, 5], [0, 7], [3, 4]], float)
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    r = S.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert abs(r.statistic - ((o - e) ** 2 / e).sum()) < 1e-9 and r.df == 2


def test_bootstrap_of_any_statistic(spark):
    """Weights, blocks and statistics by plain numpy."""
    import hashlib
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 40 == 0 else ("a" if i % 3 else "b"), float(rng.normal(50, 9)), float(rng.integers(1, 9)), float(rng.integers(0, 12))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, x double, n double, v double")
    block = {r[0]: int(hashlib.md5(f"{r[0]}|42".encode()).hexdigest()[:8], 16) % 50 for r in rows}
    w = S.block_weights(400, 50, 42)
    h = hashlib.md5(b"7|3|42").hexdigest()
    assert w[13, 7] == sum(int(h[8:16], 16) / 2**32 >= p for p in S.POISSON_STEPS)
    ratio = {r.g: r for r in S.bootstrap(df, ["g"], {"x": F.col("x"), "n": F.col("n")}, lambda t: t["x"] / t["n"], "id", resamples=400, blocks=50).collect()}
    middle = {r.g: r for r in S.bootstrap_quantile(df, ["g"], "v", "id", q=0.3, resamples=400, blocks=50).collect()}
    assert set(ratio) == set(middle) == {"a", "b", None}
    for g in ratio:
        mine = [r for r in rows if r[1] == g]
        weight = w[:, [block[r[0]] for r in mine]].astype(float)
        got = (weight @ [r[2] for r in mine]) / (weight @ [r[3] for r in mine])
        assert np.allclose([ratio[g].ci_lower, ratio[g].ci_upper], np.nanquantile(got, [0.025, 0.975]))
        order = np.argsort([r[4] for r in mine], kind="stable")
        v, reach = np.array([r[4] for r in mine])[order], np.cumsum(weight[:, order], axis=1)
        kept = reach[:, -1] > 0
        q = v[np.argmax(reach >= 0.3 * reach[:, -1:], axis=1)][kept]
        assert np.allclose([middle[g].ci_lower, middle[g].ci_upper], np.quantile(q, [0.025, 0.975]))
        assert middle[g].estimate == sorted(v)[int(np.ceil(0.3 * len(v))) - 1]


def test_bootstrap_quantile_of_many_values(spark):
    rng = np.random.default_rng(8)
    xs = rng.normal(100, 15, 4000)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id long, x double")
    r = S.bootstrap_quantile(df, [], "x", "id", resamples=1000, candidates=100).first()
    all_values = S.bootstrap_quantile(df, [], "x", "id", resamples=1000, candidates=10_000).first()
    assert r.estimate == all_values.estimate == np.sort(xs)[1999]
    assert abs(r.ci_lower - all_values.ci_lower) < 0.1 and abs(r.ci_upper - all_values.ci_upper) < 0.1
    assert abs((r.ci_upper - r.ci_lower) / 2 - 1.96 * 1.2533 * 15 / math.sqrt(4000)) < 0.15
    empty = df.filter("false")
    assert S.bootstrap_quantile(empty.withColumn("g", F.lit("a")), ["g"], "x", "id", resamples=10).collect() == []
    assert S.bootstrap(empty.withColumn("g", F.lit("a")), ["g"], {"x": F.col("x")}, lambda t: t["x"], "id", resamples=10).collect() == []


def test_many_groups_name_the_skipped_pairs(spark):
    df = spark.range(21 * 12).select((F.col("id") % 21).cast("string").alias("g"), (F.col("id") * 37 % 101).cast("double").alias("x"))
    got = S.multi_group_test(df, "g", "x", "H")
    assert "posthoc" not in got and tuple(got["skipped"].first()) == ("H", 21, 20)


def test_rounding_keeps_values_beyond_the_range_of_a_long(one):
    from staylens.functions.rounding import stable_round
    big = [3.0e13, -5.0e14, 1.0e300, 9.0e12, -2.5, 1.2345675]
    assert one("x double", [(v,) for v in big], stable_round("x", 6)) == [3.0e13, -5.0e14, 1.0e300, 9.0e12, -2.5, 1.234568]


def test_rank_sum_queries_hand_out_their_sums_unrounded(spark, monkeypatch):
    from checks import stats_queries as Q
    # sums as of 36 million rows
    sums = spark.createDataFrame([(36_000_000, 414761363702610.5, 207802254965370.5, 207802254965370.5, 1.0)], "n long, plus double, minus double, statistic double, z double")
    monkeypatch.setattr(Q.S, "signed_rank", lambda *a: sums)
    monkeypatch.setattr(Q.S, "paired_test", lambda *a: sums.select(F.lit("t").alias("test"), "statistic", F.lit(0.1234567).alias("p_value"), F.lit(0.5).alias("effect"), F.lit(0.25).alias("mean_difference")))
    monkeypatch.setattr(Q, "li", lambda s, d: s.createDataFrame([(1, 2.0)], "l_linenumber int, l_quantity double"))
    assert Q.ENTRIES["signed_rank_test"][0](spark, "").first().plus == 414761363702610.5
    assert tuple(Q.ENTRIES["paired_test"][0](spark, "").first()) == ("t", 207802254965370.5, 0.123457, 0.5, 0.25)
