"""Quantile trees and exact tree attribution, against plain loops and by held-out coverage."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.operators import attribution as A
from staylens.operators import evaluation as E
from staylens.operators import models as M
from staylens.operators import quantile_trees as Q


def uniform(k):
    return F.pmod(F.xxhash64("listing_id", F.lit(k)), F.lit(1_000_003)) / 1_000_003.0


@pytest.fixture(scope="module")
def data(spark):
    """Noise whose spread depends on b: the true 10 % and 90 % bounds bend with a and widen with b."""
    df = spark.range(8000).select(F.col("id").alias("listing_id")).select("listing_id", uniform(1).alias("a"), uniform(2).alias("b"), uniform(3).alias("c"),
                                                                         F.when(F.col("listing_id") % 2 == 0, "x").otherwise("y").alias("meta_city"))
    df = df.withColumn("target", 2 + F.sin(6 * F.col("a")) + (0.2 + F.col("b")) * (uniform(4) - 0.5))
    return df, M.training_table(df, ["a", "b", "c"])


@pytest.fixture(scope="module")
def intervals(data):
    return Q.fit_quantile_trees(data[1].filter("listing_id < 4000"), rounds=18, trees=4)


def test_quantile_trees_cover_held_out_rows(data, intervals):
    held = data[1].filter("listing_id >= 4000")
    both = M.predict_interval(intervals[0.1], intervals[0.9], held, ["listing_id", "features"])
    got = E.interval_quality(both, log_target=False).first()
    assert abs(got.coverage - 0.8) <= 0.02
    width = F.col("upper") - F.col("lower")
    x = Q.vector_to_array("features")[1]
    narrow, wide = (both.filter(c).agg(F.avg(width)).first()[0] for c in (x < 0.2, x > 0.8))
    assert wide > 1.8 * narrow  # the truth: 0.24 and 0.88


def test_quantile_trees_saved_and_explained(spark, data, intervals, tmp_path):
    model = intervals[0.9]
    model.save(spark, str(tmp_path / "q"))
    again = Q.QuantileTrees.load(spark, str(tmp_path / "q"))
    x = np.random.default_rng(1).random((50, 3))
    x[0, 1] = np.nan
    assert (again.predict(x) == model.predict(x)).all() and again.tau == 0.9
    table, mean = A.leaf_table(*A.tree_nodes(model, spark))
    assert np.allclose(A.shapley_values(x, table, 3).sum(axis=1) + mean, model.predict(x), atol=1e-9)


def test_quantile_trees_same_from_any_partitioning(data):
    some = data[1].filter("listing_id < 600")
    one, many = (Q.fit_quantile_trees(some.repartition(n), rounds=2, trees=2, depth=2)[0.1] for n in (1, 5))
    assert (one.feature == many.feature).all() and (one.threshold == many.threshold).all() and (one.value == many.value).all()


def test_quantile_trees_edge_cases(spark, data):
    with pytest.raises(ValueError):
        Q.fit_quantile_trees(data[1].limit(0))
    flat = M.training_table(spark.range(60).select(F.col("id").alias("listing_id"), F.lit(1.0).alias("a"), F.when(F.col("id") > 5, 4.0).alias("target")), ["a"])
    model = Q.fit_quantile_trees(flat, taus=(0.5,), rounds=1, trees=1, depth=2)[0.5]  # no feature to cut, missing targets left out
    assert (model.feature == -1).all() and model.predict(np.array([[1.0], [np.nan]])).tolist() == [4.0, 4.0]
    assert model.transform(flat.limit(0)).count() == 0


def test_best_split_by_loops():
    rng = np.random.default_rng(3)
    for _ in range(30):
        bins, below = rng.integers(0, 6, (4, 60)), rng.integers(0, 2, 60)  # every feature sees the same rows
        counts = np.zeros((4, 6, 2), dtype=int)
        for f in range(4):
            np.add.at(counts[f], (bins[f], below), 1)
        allowed = np.array([True, True, False, True])
        best = (-1, 0, 0.0)
        for f in range(4):
            for b in range(6):
                left, right = counts[f, :b + 1].sum(axis=0), counts[f, b + 1:].sum(axis=0)
                nl, nr = left.sum(), right.sum()
                if allowed[f] and nl >= 5 and nr >= 5:
                    gl, gr = 0.3 * nl - left[1], 0.3 * nr - right[1]
                    gain = gl ** 2 / nl + gr ** 2 / nr - (gl + gr) ** 2 / (nl + nr)
                    if gain > best[2] + 1e-9:
                        best = (f, b, gain)
        f, b, gain = Q.best_split(counts, 0.3, allowed, 5)
        assert (f < 0) == (best[0] < 0) and abs(gain - best[2]) < 1e-9


def plain_shapley(nodes, weights, x, width):
    """By the definition: all subsets of features, unknown ones averaged by the fitted rows."""
    trees = {}
    for t, n, *rest in nodes:
        trees.setdefault(t, {})[n] = rest

    def value(t, n, known):
        left, right, f, cut, v, rows = trees[t][n]
        if left < 0:
            return v
        if f in known:
            return value(t, left if x[f] <= cut else right, known)
        return sum(value(t, c, known) * trees[t][c][5] / rows for c in (left, right))
    out = np.zeros(width)
    for t in trees:
        for j in range(width):
            others = [f for f in range(width) if f != j]
            for size in range(width):
                for s in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
                    out[j] += weights[t] * w * (value(t, 0, {*s, j}) - value(t, 0, set(s)))
    return out


@pytest.mark.parametrize("family,params", [("random_forest", {"numTrees": 3, "maxDepth": 6}), ("xgboost", {"maxIter": 4, "maxDepth": 4})])
def test_tree_attribution_by_definition(spark, data, family, params):
    matrix, rows = data
    model = M.estimator(family, **params).fit(rows.filter("listing_id < 1500"))
    some = matrix.filter("listing_id < 1510 AND listing_id >= 1480")
    nodes, weights, constant = A.tree_nodes(model, spark)
    got = A.tree_attribution(model, some, ["a", "b", "c"]).collect()
    assert len(got) == 90
    mine = {(r.listing_id, r.feature): r.attribution for r in got}
    for r in some.collect():
        want = plain_shapley(nodes, weights, [r.a, r.b, r.c], 3)
        assert np.allclose([mine[r.listing_id, f] for f in "abc"], want, atol=1e-9)
    total = A.tree_attribution(model, matrix, ["a", "b", "c"]).groupBy("listing_id").agg(F.sum("attribution").alias("t"))
    off = total.join(M.predict(model, rows, ["listing_id"]), "listing_id").filter(F.abs(F.col("t") + A.expected_value(model, spark) - F.col("yhat")) > 1e-9)
    assert total.count() == 8000 and off.count() == 0


def test_tree_attribution_edge_rows(spark, data):
    matrix, rows = data
    model = M.estimator("random_forest", numTrees=2, maxDepth=3).fit(rows.limit(500))
    odd = spark.createDataFrame([(1, None, 0.5, 0.5), (1, None, 0.5, 0.5), (None, 0.2, 0.5, float("nan"))], "listing_id long, a double, b double, c double")
    got = A.tree_attribution(model, odd, ["a", "b", "c"]).collect()
    assert len(got) == 9 and all(r.attribution == r.attribution for r in got)
    assert A.tree_attribution(model, odd.limit(0), ["a", "b", "c"]).count() == 0
    single = M.estimator("random_forest", numTrees=1, maxDepth=0).fit(rows.limit(100))
    assert {r.attribution for r in A.tree_attribution(single, odd, ["a", "b", "c"]).collect()} == {0.0}


def test_explain_job_stores_its_parts(spark, data, tmp_path):
    matrix, rows = data
    model = M.estimator("random_forest", numTrees=3, maxDepth=4).fit(rows)
    out = A.explain(model, matrix, ["a", "b", "c"], M.predict(model, rows, ["listing_id"]), str(tmp_path))
    assert out["values"].count() == 24000 and spark.read.parquet(f"{tmp_path}/values").count() == 24000
    assert out["importance"].orderBy("rank").first().feature == "a"
    assert {r.meta_city for r in out["importance_by_city"].collect()} == {"x", "y"}
    assert {r.case for r in out["cases"].collect()} == {"cheapest", "dearest", "best", "worst", "middle"}
    assert spark.read.json(f"{tmp_path}/importance").count() == 3


def test_pattern_tables_give_the_plain_values():
    rng = np.random.default_rng(5)
    table = []
    for d in (1, 2, 3, 4, 7):
        feature = np.array([np.sort(rng.permutation(9)[:d]) for _ in range(20)])
        low = np.where(rng.random((20, d)) < 0.4, -np.inf, rng.random((20, d)) * 0.5)
        high = np.where(rng.random((20, d)) < 0.4, np.inf, 0.5 + rng.random((20, d)) * 0.5)
        share = np.where(rng.random((20, d)) < 0.1, 0.0, rng.random((20, d)))
        table.append(A.Leaves(feature, low, high, share, rng.normal(size=20)))
    x = rng.random((700, 9))
    x[rng.random(x.shape) < 0.05] = np.nan
    plain = A.shapley_values(x, table, 9)
    assert np.allclose(A.shapley_of_many(x, table, 9), plain, atol=1e-12)
    assert np.allclose(A.shapley_of_many(x[:40], table, 9), plain[:40], atol=1e-12)  # more patterns than rows


def test_many_rows_do_not_take_the_plain_form(monkeypatch):
    rng = np.random.default_rng(6)
    table = [A.Leaves(np.array([[0, 1, 2]] * 50), np.full((50, 3), -np.inf), rng.random((50, 3)), rng.random((50, 3)), rng.normal(size=50))]
    x = rng.random((400, 3))
    plain = A.shapley_values(x, table, 3)
    monkeypatch.setattr(A, "shapley_values", lambda *a: (_ for _ in ()).throw(AssertionError("row by row")))
    assert np.allclose(A.shapley_of_many(x, table, 3), plain, atol=1e-12)


def test_residuals_by_sorting(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 10, 11, 999):
        v = rng.normal(size=n)
        of = Q.Residuals()
        for part in np.array_split(v, 3):
            of.add(part)
        df = spark.createDataFrame([(float(x),) for x in v], "e double")
        for p in (0.0, 0.1, 0.5, 0.9, 1.0):
            assert of.quantile(p) == df.agg(F.percentile_approx("e", p, Q.ACCURACY)).first()[0]


def test_residuals_beyond_what_is_held(monkeypatch):
    monkeypatch.setattr(Q, "POINTS", 400)
    v = np.random.default_rng(6).normal(size=20_000)
    of = Q.Residuals()
    for part in np.array_split(v, 77):
        of.add(part)
        assert all(sum(map(len, held)) <= 400 for held in of.levels)
    for p in (0.1, 0.5, 0.9):
        assert abs((v <= of.quantile(p)).mean() - p) <= len(of.levels) / 400
    assert of.n == 20_000 and sum(len(v) << k for k, held in enumerate(of.levels) for v in held) == 20_000


def test_packed_counts_by_loops():
    rng = np.random.default_rng(7)
    sizes = [2, 3, 32, 2, 1, 5, 2, 31]
    columns = np.stack([rng.integers(0, s, 500) for s in sizes]).astype(np.uint8)
    packed = Q.Packed(sizes)
    assert sorted(f for p in packed.packs for f in p) == list(range(8)) and len(packed.packs) < 5
    got = packed.by_feature(np.bincount(packed.codes(columns).ravel(), minlength=packed.cells)[None])[0]
    for f in range(8):
        assert (got[f] == np.bincount(columns[f], minlength=Q.BINS)).all()


def test_routes_by_loops():
    rng = np.random.default_rng(8)
    x, feature, cut = rng.random((4, 50)), rng.integers(-1, 4, 15), rng.random(15)
    x[1, :9] = np.nan
    got = Q._leaf(x, feature, cut)
    for i in range(50):
        at = 0
        while at < 15:
            at = 2 * at + 1 + int(feature[at] >= 0 and not x[feature[at], i] <= cut[at])
        assert got[i] == at - 15


def test_importance_counts_keys_exactly(spark):
    """Groups on both sides of the bound: repeated keys, null keys and groups without a name."""
    keys = {"a": range(40), "b": range(10), "c": range(9), "d": [1, 2, 3] * 20, None: range(12), "e": [None] * 30, "f": [*range(9), None, *range(9)]}
    rows = [(k, c, "x", float(i % 3)) for c, ks in keys.items() for i, k in enumerate(ks)]
    values = spark.createDataFrame(rows, "listing_id long, city string, feature string, attribution double")
    got = {r.city: (r.rank, r.mean_abs) for r in A.importance(values, ["city"], min_rows=10).collect()}
    want = {c: (1, sum(i % 3 for i in range(len(ks))) / len(ks)) for c, ks in keys.items() if c in ("a", "b", None)}
    assert got == {c: (1, pytest.approx(m)) for c, (_, m) in want.items()}
    plan = A.importance(values.filter("city = 'a'"), ["city"], min_rows=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan  # keys of a large group are never compared


def test_leaves_of_one_cut_share_a_look_up(monkeypatch):
    """A full tree of depth 3 on three features, and one whose last cuts are on a feature of the path."""
    rng = np.random.default_rng(9)

    def tree(t, features):
        out = []
        for n in range(15):
            inner = n < 7
            out.append((t, n, 2 * n + 1 if inner else -1, 2 * n + 2 if inner else -1, features[n] if inner else -1, float(rng.random()), 0.0 if inner else float(rng.normal()), 0.0))
        count = dict(zip(range(7, 15), rng.integers(5, 50, 8).tolist()))
        for n in range(6, -1, -1):
            count[n] = count[2 * n + 1] + count[2 * n + 2]
        return [(*r[:7], float(count[r[1]])) for r in out]
    table, _ = A.leaf_table(tree(0, [0, 1, 1, 2, 2, 2, 2]) + tree(1, [0, 1, 2, 0, 1, 0, 2]), [0.5, 0.5])
    x = rng.random((400, 3))
    x[rng.random(x.shape) < 0.1] = np.nan
    shared, other_side = [], A._other_side
    monkeypatch.setattr(A, "_other_side", lambda a, b: shared.append(other_side(a, b)) or shared[-1])
    assert np.allclose(A.shapley_of_many(x, table, 3), A.shapley_values(x, table, 3), atol=1e-12)
    assert sum(s is not None for s in shared) >= 4
