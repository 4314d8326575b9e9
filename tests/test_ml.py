import math

import pytest
from pyspark.sql import functions as F

from staylens import settings
from staylens.operators import attribution as A
from staylens.operators import evaluation as E
from staylens.operators import features as X
from staylens.operators import models as M


def test_amenity_flags(spark):
    df = spark.createDataFrame([('["Wifi", "Kitchen", "Air conditioning"]',), ("[]",), (None,), ('["Backyard"]',)], "amenities string")
    got = [(r.has_wifi, r.has_kitchen, r.has_air_conditioning) for r in X.amenity_flags(df).collect()]
    assert got == [(1, 1, 1), (0, 0, 0), (0, 0, 0), (0, 0, 1)]  # "backyard" contains "ac"


def test_interactions(spark):
    df = spark.createDataFrame([(2, 1), (4, None)], "accommodates int, bedrooms int")
    assert [r.accommodates_x_bedrooms for r in X.interactions(df).collect()] == [2, 0]


def test_impute(spark):
    df = spark.createDataFrame([(1.0, True, "a"), (None, None, None), (3.0, False, "b")], "num double, flag boolean, cat string")
    out, flags = X.impute(df, ["num"], ["flag"], ["cat"])
    assert [tuple(r) for r in out.collect()] == [(1.0, 1, "a", 0), (2.0, 0, "__MISSING__", 1), (3.0, 0, "b", 0)]
    assert flags == ["is_missing_num"]
    assert X.impute(df.filter("num IS NOT NULL"), ["num"])[1] == []


def test_one_hot_cap(spark):
    df = spark.createDataFrame([(c,) for c in ["red"] * 3 + ["blue"] * 2 + ["green", "pink"]], "color string")
    out, names = X.one_hot(df, ["color"], cap=2)
    assert names == ["color_blue", "color_red"] and out.columns == names
    assert [out.agg(F.sum(n)).first()[0] for n in names] == [2, 3]


def test_split_is_exact_and_stable(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("s")).unionByName(spark.createDataFrame([(5000, 9)], "id long, s long"))
    a = X.stratified_split(df, "id", ["s"])
    per = {r.s: r.n for r in a.filter("is_test").groupBy("s").agg(F.count("id").alias("n")).collect()}
    assert per[0] == 67 and per[1] == 67 and per[2] == 67
    b = X.stratified_split(df.repartition(5), "id", ["s"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    folds = X.stratified_folds(df, "id", ["s"], folds=5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds)[0] >= 197 and len(folds) == 5


def test_metrics(spark):
    rows = [("m", math.log1p(100), math.log1p(110)), ("m", math.log1p(200), math.log1p(180))]
    r = E.metrics(spark.createDataFrame(rows, "model string, y double, yhat double")).first()
    assert abs(r.mae - 15) < 1e-9 and abs(r.mape - 10) < 1e-9 and abs(r.median_ae - 15) < 1e-9
    assert abs(r.r2 - (1 - 500 / 5000)) < 1e-9


def test_group_errors_and_bias(spark):
    rows = [(i, 100.0, 90.0 if i % 2 else 110.0, "over" if i % 2 == 0 else "under") for i in range(30)]
    df = spark.createDataFrame(rows, "listing_id long, y double, yhat double, city string")
    e = {r.group: r for r in E.stratified_errors(df, ["city", "absent"], min_rows=10, log_target=False).collect()}
    assert e["over"].mae == 10 and e["over"].mean_residual == -10 and e["under"].median_residual == 10
    b = {r.group: r for r in E.group_bias(df, ["city"], resamples=200, log_target=False).collect()}
    assert b["over"].direction == "over-predicted" and b["under"].direction == "under-predicted"
    assert b["over"].is_significant and b["over"].magnitude == "large"
    assert E.fairness_summary(E.group_bias(df, ["city"], resamples=200, log_target=False)).first().overall_risk == "HIGH"
    assert E.fairness_summary(E.group_bias(df.limit(0), ["city"], resamples=8, log_target=False)).first().overall_risk == "LOW"


def test_fairness_flags_of_matrix_columns(spark):
    df = spark.range(400).select(F.col("id").alias("listing_id"), F.lit(100.0).alias("y"), F.when(F.col("id") % 2 == 0, 90.0).otherwise(110.0).alias("yhat"),
                                 *[(F.col("id") % 2).cast("string").alias(c) for c in ("meta_neighbourhood_group", "meta_price_quintile", "meta_has_reviews", "meta_room_type")])
    for dimension, flag in (("meta_neighbourhood_group", "geographic_bias"), ("meta_price_quintile", "price_range_bias"), ("meta_has_reviews", "cold_start_bias"), ("meta_room_type", None)):
        r = E.fairness_summary(E.group_bias(df, [dimension], resamples=100, log_target=False)).first()
        assert r.significant_biases == 2
        assert [f for f in ("geographic_bias", "price_range_bias", "cold_start_bias") if r[f]] == ([flag] if flag else [])


@pytest.fixture(scope="module")
def matrix(spark):
    df = spark.range(400).select(
        F.col("id").alias("listing_id"), ((F.col("id") * 37) % 101 / 101.0).alias("a"), ((F.col("id") * 53) % 97 / 97.0).alias("b"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("meta_city"), (F.col("id") % 4).cast("string").alias("meta_neighbourhood_group"),
        (F.col("id") % 3).cast("int").alias("fold"))
    return df.withColumn("target", 3 + 2 * F.col("a") - F.col("b"))


def test_models_fit_and_explain(spark, matrix, tmp_path):
    data = M.training_table(matrix, ["a", "b"])
    model = M.estimator("ridge", regParam=0.0).fit(data)
    assert [round(v, 4) for v in model.coefficients] == [2.0, -1.0]
    values = A.linear_attribution(model, matrix, ["a", "b"])
    total = values.groupBy("listing_id").agg(F.sum("attribution").alias("t")).join(M.predict(model, data, ["listing_id"]), "listing_id")
    mean = matrix.agg(F.avg("target")).first()[0]
    assert total.filter(F.abs(F.col("t") + mean - F.col("yhat")) > 1e-6).count() == 0
    assert A.importance(values).orderBy("rank").first().feature == "a"
    tree = M.estimator("random_forest", numTrees=3, maxDepth=3).fit(data)
    tv = A.tree_attribution(tree, matrix, ["a", "b"], sample=20)
    assert tv.count() == 40
    cases = A.explain_cases(model, matrix, ["a", "b"], M.predict(model, data, ["listing_id"]))
    assert {r.case for r in cases.select("case").collect()} == {"cheapest", "dearest", "best", "worst", "middle"}
    result = M.train_experiment(data, {"ridge": {"search": "grid", "grid": {"regParam": [0.0, 10.0]}}}, folds=3, quantiles=(0.5,))
    assert result["best"] == "ridge" and result["params"]["ridge"]["regParam"] == 0.0
    root = M.save_experiment(result, str(tmp_path))
    again = M.load_model(root, "ridge")
    assert abs(again.intercept - result["models"]["ridge"].intercept) < 1e-12
    middle = M.load_model(root, M.bound_name(0.5), spark)
    assert middle.transform(data).filter("abs(yhat - target) < 0.3").count() > 360
    assert M.cross_validate(M.estimator("ridge"), data, "ridge", 3).count() == 3


def test_registered_experiment_searches_all_families(spark, matrix, monkeypatch, tmp_path):
    from checks import ml_queries, operator_queries
    data, asked = M.training_table(matrix.withColumn("is_test", F.col("listing_id") % 5 == 0), ["a", "b"]), []

    def short(data, families=None, *args):
        asked.append((families or settings.MODELS, args))
        return train(data, {"ridge": settings.MODELS["ridge"]}, folds=3, quantiles=())
    train = M.train_experiment
    monkeypatch.setattr(ml_queries.M, "train_experiment", short)
    monkeypatch.setattr(ml_queries, "_matrix", lambda s, d: (matrix, ["a", "b"], data))
    monkeypatch.setattr(ml_queries, "META", ["listing_id", "meta_city"])
    monkeypatch.setattr(operator_queries, "_scratch", lambda s, d, name: str(tmp_path / name))
    assert ml_queries._experiment(spark, "none").first().n_samples == 80
    assert asked == [(settings.MODELS, ())] and list(settings.MODELS) == ["ridge", "random_forest", "xgboost", "lightgbm"]


def test_generalisation_checks(matrix):
    data = M.training_table(matrix, ["a", "b"])
    est = M.estimator("ridge", regParam=0.01)
    out = M.leave_group_out(est, data, min_rows=30)
    assert out.count() == 4 and out.first().n_train == 100
    t = M.city_transfer(est, matrix, ["a", "b"]).collect()
    assert len(t) == 4 and all(r.mae_degradation == 0 for r in t if r.train_city == r.eval_city)
    assert M.area_ablation(est, matrix, ["a", "b"]) is None
    wide = matrix.withColumn("nbhd_z", F.col("a") * 0.5)
    assert M.area_ablation(est, wide, ["a", "b", "nbhd_z"]).first().removed == "nbhd_z"


def test_scoring_fills_and_clamps(spark):
    names = ["accommodates", "bedrooms", "accommodates_x_bedrooms"]
    df = spark.createDataFrame([(1, 3.0), (2, None)], "listing_id long, accommodates double")
    got = [(r.accommodates, r.bedrooms, r.accommodates_x_bedrooms) for r in M.scoring_rows(df, names).collect()]
    assert got == [(3.0, 1.0, 3.0), (2.0, 1.0, 2.0)]
    train = M.assemble(M.scoring_rows(spark.range(50).select(F.col("id").alias("listing_id"), (F.col("id") % 5).cast("double").alias("accommodates"),
                                                             (4 + F.col("id") % 5 / 10).alias("target")), names), names)
    model = M.estimator("ridge", regParam=0.01).fit(train)
    r = M.score_prices(model, df, names).first()
    assert 10 <= r.price_low <= r.price <= r.price_high


def test_one_hot_without_cap_fails_beyond_its_bound(spark, monkeypatch):
    df = spark.range(40).select((F.col("id") % 8).cast("string").alias("c"))
    assert len(X.one_hot(df, ["c"], cap=None)[1]) == 7
    monkeypatch.setattr(X.settings, "MAX_DUMMIES", 5)
    with pytest.raises(ValueError):
        X.one_hot(df, ["c"], cap=None)
