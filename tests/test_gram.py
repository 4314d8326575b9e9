"""Ridge from cross-product matrices against refitting and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.operators import gram as G
from staylens.operators import models as M


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    n = 900
    x = rng.normal(size=(n, 4)) * [1, 20, 0.1, 3] + [0, 100, 5, -3]
    x[:, 2] = 7.0  # no spread
    y = 1 + 0.3 * x[:, 0] + 0.01 * x[:, 1] - 0.1 * x[:, 3] + rng.normal(size=n) * 0.2
    area = [None if i % 17 == 0 else f"a{i % 13}" if i % 3 else "big" for i in range(n)]
    rows = [(i, f"c{i % 2}" if i % 50 else None, area[i], i % 5, *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, meta_city string, meta_neighbourhood_group string, fold int, x0 double, x1 double, x2 double, x3 double, target double")


FEATURES = ["x0", "x1", "x2", "x3"]


def numpy_ridge(x, y, alpha):
    mean, sd = x.mean(0), x.std(0)
    used = sd > 1e-9
    z = (x[:, used] - mean[used]) / sd[used]
    w = np.zeros(x.shape[1])
    w[used] = np.linalg.solve(z.T @ z + alpha * np.eye(used.sum()), z.T @ (y - y.mean())) / sd[used]
    return y.mean() - mean @ w, w


def frame(points):
    p = points.toPandas()
    return p, p[FEATURES].to_numpy(), p.target.to_numpy()


def test_matrices_add_up(points, monkeypatch):
    p, x, y = frame(points)
    a = np.column_stack([np.ones(len(p)), x, y])
    got = {r.meta_neighbourhood_group: G.unpacked(r.matrix) for r in G.cross_products(points, ["meta_neighbourhood_group"], FEATURES).collect()}
    assert set(got) == set(p.meta_neighbourhood_group) | {None}
    for k, m in got.items():
        mine = a[p.meta_neighbourhood_group.isna() if k is None else (p.meta_neighbourhood_group == k)]
        assert np.allclose(m, mine.T @ mine)
    whole = G.merged(G.cross_products(points, ["fold", "meta_city"], FEATURES), []).first()
    assert np.allclose(G.unpacked(whole.matrix), a.T @ a)


def test_solve_is_ridge(points):
    p, x, y = frame(points)
    m = G.unpacked(G.cross_products(points, [], FEATURES).first().matrix)
    for alpha in (0.0, 1.0, 500.0):
        b, w = G.solve(m, alpha)
        wb, ww = numpy_ridge(x, y, alpha)
        assert np.allclose(w, ww, atol=1e-8) and np.isclose(b, wb)


def test_out_of_fold_equals_refitting(points):
    p, x, y = frame(points)
    got = {(r.id, r.alpha): r.yhat for r in G.out_of_fold(points, [0.5, 50.0], ["id"], FEATURES).collect()}
    assert len(got) == 2 * len(p)
    for k in range(5):
        rest = (p.fold != k).to_numpy()
        for alpha in (0.5, 50.0):
            b, w = numpy_ridge(x[rest], y[rest], alpha)
            for i in np.flatnonzero(~rest)[:20]:
                assert np.isclose(got[(p.id[i], alpha)], b + x[i] @ w)


def test_reg_param_is_that_of_mllib(points):
    data = M.training_table(points, FEATURES)
    ours = {r.fold: r.mae for r in G.cross_validate(data, 0.3, as_reg_param=True).collect()}
    theirs = {r.fold: r.mae for r in M.cross_validate(M.estimator("ridge", regParam=0.3), data, "ridge").collect()}
    assert ours == pytest.approx(theirs, rel=1e-6)
    grid = [0.0, 0.3, 30.0]
    assert M.tune("ridge", data, {"grid": {"regParam": grid}})[1]["regParam"] == G.best_alpha(data, grid, as_reg_param=True) < 30.0


def test_leave_group_out_equals_refitting(points):
    p, x, y = frame(points)
    rows = {(r.city, r.neighbourhood_group): r for r in G.leave_group_out(points, 2.0, features=FEATURES, min_rows=10, baseline_mae=1.0).collect()}
    want = set()
    for c in ("c0", "c1"):
        for g in set(p.meta_neighbourhood_group.dropna()):
            test = ((p.meta_city == c) & (p.meta_neighbourhood_group == g)).to_numpy()
            train = (p.meta_city == c).to_numpy() & ~test
            if test.sum() < 10:
                continue
            want.add((c, g))
            b, w = numpy_ridge(x[train], y[train], 2.0)
            e = np.expm1(y[test]) - np.maximum(np.expm1(b + x[test] @ w), 0)
            r = rows[(c, g)]
            assert (r.n_train, r.n_test) == (train.sum(), test.sum())
            assert np.isclose(r.mae, np.abs(e).mean()) and np.isclose(r.mean_residual, e.mean()) and np.isclose(r.gap_vs_cv, r.mae - 1)
    assert set(rows) == want and len(want) > 20


def test_many_groups_and_empty(points, spark):
    many = points.withColumn("meta_neighbourhood_group", (F.col("id") % 300).cast("string")).withColumn("meta_city", F.lit("c"))
    assert G.leave_group_out(many, 1.0, features=FEATURES, min_rows=3).count() == 300
    assert G.leave_group_out(points.filter("false"), 1.0, features=FEATURES).collect() == []
    assert G.cross_products(points.filter("false"), ["fold"], FEATURES).collect() == []
