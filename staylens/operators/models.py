"""Price models on MLlib: tuning, cross-validation, quantile models, generalisation checks, batch scoring."""

import datetime as dt
import hashlib
import json
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel,
                                   RandomForestRegressionModel, RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings
from ..functions.rounding import rows
from . import evaluation as E
from . import gram
from .distribution import rows_union
from .ordering import checkpointed, positions
from .quantile_trees import QuantileTrees, fit_quantile_trees

SEED = settings.SPLIT_SEED
PARALLEL = 4  # models fitted at the same time; each fit is itself a distributed job
LOADERS = {"ridge": LinearRegressionModel, "random_forest": RandomForestRegressionModel, "xgboost": GBTRegressionModel,
           "lightgbm": GBTRegressionModel}


def estimator(name: str, **params):
    """Unfitted model of a family: ridge, random_forest, or boosted trees for the two boosting families."""
    common = {"labelCol": "target", "featuresCol": "features", "predictionCol": "yhat"}
    if name == "ridge":
        return LinearRegression(**{**common, "elasticNetParam": 0.0, "solver": "normal", **params})
    if name == "random_forest":
        return RandomForestRegressor(**{**common, "seed": SEED, **params})
    if name in ("xgboost", "lightgbm"):
        return GBTRegressor(**{**common, "seed": SEED, "featureSubsetStrategy": "0.8", **params})
    raise ValueError(f"unknown model family {name!r}")


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def training_table(matrix: DataFrame, features: list[str]) -> DataFrame:
    """The assembled rows written once: every fit of a search reads them."""
    keep = [c for c in matrix.columns if c not in features]
    return checkpointed(assemble(matrix, features).select(*keep, "features"))


def param_maps(est, grid: dict[str, list], search: str = "grid", draws: int | None = None, seed: int = SEED) -> list:
    """All combinations, or a seeded subset of them for random search."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), values)
    maps = builder.build()
    if search == "random" and draws and draws < len(maps):
        maps = random.Random(seed).sample(maps, draws)
    return maps


def tune(name: str, data: DataFrame, spec: dict | None = None, folds: int = settings.FOLDS):
    """Best estimator and parameters by mean absolute error over the ``fold`` column."""
    spec = spec or settings.MODELS[name]
    est = estimator(name)
    if name == "ridge" and set(spec["grid"]) == {"regParam"} and spec.get("search", "grid") == "grid":
        # all penalties and folds from one scan instead of a fit for each
        best = gram.best_alpha(data.filter(F.col("fold") < folds), spec["grid"]["regParam"], as_reg_param=True)
        return estimator(name, regParam=best), {"regParam": best}
    maps = param_maps(est, spec["grid"], spec.get("search", "grid"), spec.get("draws"))
    if len(maps) == 1:
        best = maps[0]
    else:
        cv = CrossValidator(estimator=est, estimatorParamMaps=maps, foldCol="fold", numFolds=folds, parallelism=PARALLEL,
                            evaluator=RegressionEvaluator(labelCol="target", predictionCol="yhat", metricName="mae"))
        fitted = cv.fit(data)
        best = maps[min(range(len(maps)), key=lambda i: fitted.avgMetrics[i])]
    params = {p.name: v for p, v in best.items()}
    return estimator(name, **params), params


def out_of_fold(est, data: DataFrame, keep: list[str], folds: int = settings.FOLDS) -> DataFrame:
    """Predictions for every row from a model that did not see its fold."""
    def one(i: int) -> DataFrame:
        model = est.fit(data.filter(F.col("fold") != i))
        return model.transform(data.filter(F.col("fold") == i)).select(*keep, "fold", F.col("target").alias("y"), "yhat")
    with ThreadPoolExecutor(PARALLEL) as pool:
        return rows_union(list(pool.map(one, range(folds))))


def cross_validate(est, data: DataFrame, name: str = "", folds: int = settings.FOLDS) -> DataFrame:
    """Metrics per fold."""
    return E.metrics(out_of_fold(est, data, [], folds).withColumn("model", F.lit(name)), ["model", "fold"])


def predict(model, data: DataFrame, keep: list[str], name: str = "") -> DataFrame:
    return model.transform(data).select(F.lit(name).alias("model"), *keep, F.col("target").alias("y"), "yhat")


def experiment_id(config: dict, now: dt.datetime | None = None) -> str:
    """Time stamp and fingerprint of the configuration."""
    stamp = (now or dt.datetime.now(dt.timezone.utc)).strftime("%Y%m%d_%H%M%S")
    return f"{stamp}_{hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:8]}"


def train_experiment(data: DataFrame, families: dict[str, dict] | None = None, folds: int = settings.FOLDS,
                     quantiles: tuple = settings.QUANTILES) -> dict:
    """Tunes, cross-validates and fits every family, then the interval bounds; the best family has the smallest mean absolute error."""
    families = families or settings.MODELS
    models, params, scores = {}, {}, []
    for name, spec in families.items():
        est, params[name] = tune(name, data, spec, folds)
        scores.append(gram.cross_validate(data, params[name]["regParam"], name, as_reg_param=True) if set(params[name]) == {"regParam"}
                      else cross_validate(est, data, name, folds))
        models[name] = est.fit(data)
    summary = checkpointed(E.cv_summary(rows_union(scores)))
    best = summary.orderBy("mae_mean", "model").first()
    return {"id": experiment_id(families), "models": models, "params": params, "cv": summary, "best": best.model, "best_mae": best.mae_mean,
            "bounds": fit_quantile_trees(data, quantiles) if quantiles else {}}


def save_experiment(result: dict, path: str) -> str:
    root = f"{path}/{result['id']}"
    for name, model in result["models"].items():
        model.write().overwrite().save(f"{root}/models/{name}")
    spark = result["cv"].sparkSession
    for tau, model in result["bounds"].items():
        model.save(spark, f"{root}/models/{bound_name(tau)}")
    result["cv"].write.mode("overwrite").json(f"{root}/metrics")
    spark.createDataFrame([(n, json.dumps(p), n == result["best"]) for n, p in result["params"].items()],
                          "model string, params string, is_best boolean").write.mode("overwrite").json(f"{root}/params")
    return root


def bound_name(tau: float) -> str:
    return f"quantile_{tau:.2f}"


def load_model(root: str, name: str, spark: SparkSession | None = None):
    """A stored model; interval bounds go by ``bound_name`` and need the session."""
    path = f"{root}/models/{name}"
    return LOADERS[name].load(path) if name in LOADERS else QuantileTrees.load(spark, path)


def predict_interval(low, high, data: DataFrame, keep: list[str]) -> DataFrame:
    """Lower and upper bound per row, ordered."""
    first = low.transform(data).withColumnRenamed("yhat", "_lo")
    both = high.transform(first).withColumnRenamed("yhat", "_hi")
    return both.select(*keep, F.col("target").alias("y"), F.least("_lo", "_hi").alias("lower"), F.greatest("_lo", "_hi").alias("upper"))


# ---- generalisation ----------------------------------------------------------------------------------------
def leave_group_out(est, data: DataFrame, city: str = "meta_city", group: str = "meta_neighbourhood_group", min_rows: int = 30,
                    baseline_mae: float = 0.0) -> DataFrame:
    """Errors on each area group of a city from a model trained on the city's other groups."""
    sizes = data.groupBy(city, group).agg(rows().alias("n")).filter(F.col(group).isNotNull() & F.col(city).isNotNull()).collect()
    totals: dict = {}
    for r in data.groupBy(city).agg(rows().alias("n")).collect():
        totals[r[city]] = r.n
    jobs = [(r[city], r[group], r.n) for r in sizes if r.n >= min_rows and totals[r[city]] - r.n >= min_rows]

    def one(job) -> DataFrame:
        c, g, n = job
        mine = data.filter(F.col(city) == c)
        model = est.fit(mine.filter((F.col(group) != g) | F.col(group).isNull()))
        pred = predict(model, mine.filter(F.col(group) == g), [city, group]).drop("model")
        return pred.withColumn("n_train", F.lit(totals[c] - n))
    if not jobs:
        return data.sparkSession.createDataFrame([], "city string, neighbourhood_group string, n_train long, n_test long, mae double, "
                                                     "mape double, mean_residual double, gap_vs_cv double")
    with ThreadPoolExecutor(PARALLEL) as pool:
        preds = rows_union(list(pool.map(one, jobs)))
    src = E.on_price_scale(preds)
    e = F.abs("residual")
    return src.groupBy(F.col(city).alias("city"), F.col(group).alias("neighbourhood_group")).agg(
        F.max("n_train").cast("long").alias("n_train"), rows().alias("n_test"), F.avg(e).alias("mae"),
        (F.avg(F.when(F.col("truth") > 1, e / F.col("truth"))) * 100).alias("mape"), F.avg("residual").alias("mean_residual")
    ).withColumn("gap_vs_cv", F.col("mae") - F.lit(baseline_mae))


def city_transfer(est, matrix: DataFrame, features: list[str], city: str = "meta_city", skip_prefixes: tuple = ("nbhd_", "city_"),
                  min_rows: int = 50) -> DataFrame:
    """Train on one city, score all; the in-city baseline trains on the first 80 % of a city's rows by key."""
    used = [f for f in features if not f.startswith(skip_prefixes)]
    data = training_table(matrix, used)
    counts = {r[city]: r.n for r in data.groupBy(city).agg(rows().alias("n")).collect()}
    cities = sorted(c for c, n in counts.items() if c is not None and n >= min_rows)
    if len([c for c in counts if c is not None]) < 2:
        return data.sparkSession.createDataFrame([], "train_city string, eval_city string, n_eval long, mae double, mape double, r2 double, "
                                                     "n_train long, mae_degradation double")
    placed = checkpointed(positions(data, [city], ["listing_id"], "_at"))

    def scored(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
        return predict(est.fit(train), test, [city]).drop("model").withColumn("train_city", F.lit(label))

    def one(c: str) -> list[DataFrame]:
        mine = placed.filter(F.col(city) == c)
        cut = int(counts[c] * 0.8)
        return [scored(mine, placed.filter(F.col(city).isin(cities)), c),
                scored(mine.filter(F.col("_at") <= cut), mine.filter(F.col("_at") > cut), "baseline")]
    with ThreadPoolExecutor(PARALLEL) as pool:
        preds = rows_union([p for pair in pool.map(one, cities) for p in pair])
    m = E.metrics(preds.withColumnRenamed(city, "eval_city"), ["train_city", "eval_city"])
    base = m.filter("train_city = 'baseline'").select("eval_city", F.col("mae").alias("_base"))
    size = F.create_map(*[x for c in cities for x in (F.lit(c), F.lit(counts[c]))])
    return m.filter("train_city <> 'baseline'").join(base, "eval_city", "left").select(
        "train_city", "eval_city", F.col("n_samples").alias("n_eval"), "mae", "mape", "r2", size[F.col("train_city")].cast("long").alias("n_train"),
        F.when(F.col("train_city") == F.col("eval_city"), F.lit(0.0)).otherwise(F.col("mae") - F.coalesce("_base", F.lit(0.0))).alias("mae_degradation"))


def area_ablation(est, matrix: DataFrame, features: list[str], folds: int = 3) -> DataFrame | None:
    """Log-scale error with and without the area features."""
    areas = [f for f in features if "neighbourhood" in f.lower() or f.startswith("nbhd_")]
    if not areas:
        return None
    def mae(names: list[str], label: str) -> DataFrame:
        preds = out_of_fold(est, training_table(matrix, names), [], folds)
        return preds.groupBy("fold").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("m")).agg(F.avg("m").alias(label))
    a, b = mae(features, "mae_with"), mae([f for f in features if f not in areas], "mae_without")
    both = a.withColumn("mae_without", b.scalar())
    return both.select("mae_with", "mae_without", (F.col("mae_without") - F.col("mae_with")).alias("absolute_degradation"),
                       ((F.col("mae_without") / F.col("mae_with") - 1) * 100).alias("relative_degradation_pct"),
                       F.lit(",".join(areas)).alias("removed"))


# ---- scoring -------------------------------------------------------------------------------------------------
def scoring_rows(df: DataFrame, features: list[str], defaults: dict[str, float] = settings.ESTIMATOR_DEFAULTS) -> DataFrame:
    """Feature columns of new rows: given values, else defaults, else 0; interactions computed again."""
    keep = [c for c in df.columns if c not in features]
    crossed = {f"{a}_x_{b}": (a, b) for a, b in settings.INTERACTIONS}
    base = df.select(*keep, *[(F.coalesce(F.col(f).cast("double"), F.lit(defaults.get(f, 0.0))) if f in df.columns
                               else F.lit(float(defaults.get(f, 0.0)))).alias(f) for f in features])
    again = {c: F.col(a) * F.col(b) for c, (a, b) in crossed.items() if c in features and a in features and b in features}
    return base.withColumns(again) if again else base


def score_prices(model, df: DataFrame, features: list[str], low=None, high=None, keep: list[str] = ["listing_id"]) -> DataFrame:
    """Price and bounds; without quantile models the bounds are 80 % and 120 % of the log-scale prediction."""
    data = assemble(scoring_rows(df, features), features)
    out = model.transform(data).withColumnRenamed("yhat", "_p")
    for m, name, factor in ((low, "_lo", 0.8), (high, "_hi", 1.2)):
        out = m.transform(out).withColumnRenamed("yhat", name) if m is not None else out.withColumn(name, F.col("_p") * factor)
    price = F.expm1("_p")
    return out.select(*keep, price.alias("price"), F.least(price, F.greatest(F.lit(10.0), F.expm1("_lo"))).alias("price_low"),
                      F.greatest(price, F.expm1("_hi")).alias("price_high"))
