"""Registered queries: features, splits, models, evaluation, attribution, bias audit."""

from pyspark.sql import functions as F

from staylens import settings
from staylens.functions.rounding import rows
from staylens.operators import attribution as A
from staylens.operators import evaluation as E
from staylens.operators import features as X
from staylens.operators import gram as G
from staylens.operators import models as M
from staylens.operators.ordering import checkpointed
from staylens.operators.quantile_trees import fit_quantile_trees
from staylens.plans.market import row_bound

from .layers import fixed, wh
from .operator_queries import silver, table
from .oracle_base import R, statement

ENTRIES: dict[str, tuple] = {}


def op(name, build, sql=None, extra=None, digits=6):
    ENTRIES[name] = (lambda s, d: fixed(build(s, d), digits), statement(sql, extra) if sql else None)


# ---- features ---------------------------------------------------------------------------------------------
FEAT = {"fr": """SELECT f.* EXCLUDE (is_professional_host), c.display_name city, c.city_name, p.room_type, p.accommodates, p.bedrooms, p.beds, p.bathrooms, p.amenities, p.amenity_count,
 p.instant_bookable, n.neighbourhood_group, h.host_is_superhost, h.host_identity_verified, h.host_response_time, h.host_response_rate, h.host_listings_count, h.is_professional_host
 FROM fact_listing_snapshot f JOIN dim_city c USING (city_key) JOIN dim_property p USING (property_key) JOIN dim_neighbourhood n USING (neighbourhood_key) JOIN dim_host h USING (host_key)
 WHERE f.price_usd > 0""",
        "tr": "SELECT *, ln(1 + price_usd) target FROM fr WHERE price_usd <= (SELECT quantile_cont(price_usd, 0.99) FROM fr)",
        "qt": "SELECT *, CASE WHEN price_usd <= q[1] THEN 'Q1' WHEN price_usd <= q[2] THEN 'Q2' WHEN price_usd <= q[3] THEN 'Q3' WHEN price_usd <= q[4] THEN 'Q4' ELSE 'Q5' END price_quintile, "
              "(number_of_reviews > 0)::INT has_reviews FROM tr, (SELECT quantile_cont(price_usd, [0.2, 0.4, 0.6, 0.8]) q FROM tr)"}


def feat(*names):
    return {k: FEAT[k] for k in ("fr", "tr", "qt") if k in names}


_FR = ["listing_id", "city", "room_type", "accommodates", "bedrooms", "amenity_count", "neighbourhood_group", "host_is_superhost", "host_response_time",
       "host_listings_count", "is_professional_host", "number_of_reviews", "price_usd"]
op("feature_rows", lambda s, d: X.feature_rows(wh(s, d).star).select(*_FR, F.col("city_key")),
   f"SELECT {', '.join(_FR[:-1])}, {R('price_usd', 6)} price_usd, city_name city_key FROM fr", feat("fr"))
_FLAGS = ", ".join(f"({' OR '.join(f'''contains(t, '{w}')''' for w in ws)})::INT {n}" for n, ws in settings.AMENITY_FLAGS.items())
op("amenity_flags", lambda s, d: X.amenity_flags(silver(s, d, "listings").select("listing_url", "amenities")).drop("amenities"),
   f"SELECT listing_url, {_FLAGS} FROM (SELECT listing_url, coalesce(lower(CASE WHEN amenities LIKE '[%' THEN array_to_string(from_json(amenities, '[\"VARCHAR\"]'), ' ') ELSE amenities END), '') t FROM s_listings)")
op("interactions", lambda s, d: X.interactions(silver(s, d, "listings")).select("listing_url", "accommodates_x_bedrooms", "bedrooms_x_bathrooms"),
   f"SELECT listing_url, {R('coalesce(accommodates, 0) * coalesce(bedrooms, 0)', 6)} accommodates_x_bedrooms, {R('coalesce(bedrooms, 0) * coalesce(bathrooms, 0)', 6)} bedrooms_x_bathrooms FROM s_listings")
op("impute_features", lambda s, d: X.impute(silver(s, d, "listings").select("listing_url", "review_scores_rating", "reviews_per_month", "accommodates", "host_is_superhost", "host_response_time"),
                                            ["review_scores_rating", "reviews_per_month", "accommodates"], ["host_is_superhost"], ["host_response_time"])[0],
   f"SELECT listing_url, {R('coalesce(review_scores_rating, a)', 6)} review_scores_rating, {R('coalesce(reviews_per_month, b)', 6)} reviews_per_month, accommodates, coalesce(host_is_superhost, false)::INT host_is_superhost, "
   "coalesce(host_response_time, '__MISSING__') host_response_time, (review_scores_rating IS NULL)::INT is_missing_review_scores_rating, (reviews_per_month IS NULL)::INT is_missing_reviews_per_month "
   "FROM s_listings, (SELECT median(review_scores_rating) a, median(reviews_per_month) b FROM s_listings)")
_TOP = {"top3": "SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 3"}


def _one_hot(s, d):
    df, names = X.one_hot(table(s, d, "part").select("p_partkey", "p_brand"), ["p_brand"], cap=3)
    # names depend on the data, so values are compared as (key, category) pairs
    return df.select("p_partkey", F.inline(F.array(*[F.struct(F.lit(n.removeprefix("p_brand_")).alias("category"), F.col(f"`{n}`").alias("v")) for n in names])))


op("one_hot", _one_hot,
   """SELECT p_partkey, c category, (coalesce(t.p_brand, '__OTHER__') = c)::INT v FROM part LEFT JOIN top3 t USING (p_brand),
 (SELECT c FROM (SELECT p_brand c FROM top3 UNION ALL SELECT '__OTHER__') ORDER BY c COLLATE "C" OFFSET 1)""".replace(' COLLATE "C"', ""), _TOP)
op("frequent_dummies", lambda s, d: _dummy_totals(s, d),
   "SELECT neighbourhood_group AS value, count(*) n FROM tl GROUP BY 1 HAVING count(*) >= 20 AND neighbourhood_group > (SELECT min(neighbourhood_group) FROM tl)",
   {**feat("fr"), "tl": "SELECT * FROM fr WHERE price_local <= (SELECT quantile_cont(price_local, 0.99) FROM fr)"})


def _dummy_totals(s, d):
    df, names = X.regression_columns(wh(s, d).star, ["accommodates"], ["host_is_superhost"], min_rows=20)
    areas = [n for n in names if n.startswith("nbhd_")]
    wide = df.agg(*[F.sum(f"`{n}`").alias(f"a{i}") for i, n in enumerate(areas)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n.removeprefix("nbhd_")).alias("value"), F.col(f"a{i}").alias("n")) for i, n in enumerate(areas)])))


op("price_quintile", lambda s, d: X.with_price_quintile(X.with_target(X.feature_rows(wh(s, d).star))).withColumn("has_reviews", (F.col("number_of_reviews") > 0).cast("int"))
   .select("listing_id", "price_quintile", "has_reviews"), "SELECT listing_id, price_quintile, has_reviews FROM qt", FEAT)
op("log_target", lambda s, d: X.with_target(X.feature_rows(wh(s, d).star)).select("listing_id", "target", X.from_target("target").alias("back")),
   f"SELECT listing_id, {R('target', 6)} target, {R('exp(target) - 1', 6)} back FROM tr", feat("fr", "tr"))
_MX = ["listing_id", "target", "meta_city", "meta_price_quintile", "meta_has_reviews", "accommodates", "bedrooms", "reviews_per_month", "review_scores_rating", "host_is_superhost",
       "has_wifi", "has_air_conditioning", "distance_to_centre_km", "accommodates_x_bedrooms", "is_missing_review_scores_rating", "room_type_Private room", "room_type_Shared room"]
op("feature_matrix", lambda s, d: X.feature_matrix(wh(s, d).star)[0].select(*[F.col(f"`{c}`") for c in _MX]),
   f"""SELECT listing_id, {R('target', 6)} target, city meta_city, price_quintile meta_price_quintile, has_reviews meta_has_reviews, {R('accommodates', 6)} accommodates,
 {R('coalesce(bedrooms, (SELECT median(bedrooms) FROM qt))', 6)} bedrooms, {R('coalesce(reviews_per_month, (SELECT median(reviews_per_month) FROM qt))', 6)} reviews_per_month,
 {R('coalesce(review_scores_rating, (SELECT median(review_scores_rating) FROM qt))', 6)} review_scores_rating, coalesce(host_is_superhost, false)::DOUBLE host_is_superhost,
 coalesce(contains(lower(amenities), 'wifi'), false)::DOUBLE has_wifi, coalesce(contains(lower(amenities), 'air conditioning') OR contains(lower(amenities), 'ac'), false)::DOUBLE has_air_conditioning,
 {R('coalesce(km, (SELECT median(km) FROM dk))', 6)} distance_to_centre_km, {R('coalesce(accommodates, 0) * coalesce(bedrooms, 0)', 6)} accommodates_x_bedrooms,
 (review_scores_rating IS NULL)::DOUBLE is_missing_review_scores_rating, (room_type = 'Private room')::DOUBLE "room_type_Private room", (room_type = 'Shared room')::DOUBLE "room_type_Shared room" FROM dk""",
   {**FEAT, "dk": """SELECT *, CASE WHEN city_name = 'new_york_city' THEN 2 * 6371e0 * asin(sqrt(pow(sin((radians(40.7128e0) - radians(latitude)) / 2), 2) + cos(radians(latitude)) *
 cos(radians(40.7128e0)) * pow(sin((radians(-74.0060e0) - radians(longitude)) / 2), 2))) END km FROM qt"""})
op("stratified_split", lambda s, d: X.stratified_split(table(s, d, "part").withColumn("band", F.floor(F.col("p_size") / 10)), "p_partkey", ["p_type", "band"]).select("p_partkey", "is_test"),
   """SELECT p_partkey, row_number() OVER (PARTITION BY g ORDER BY md5(p_partkey || '42'), p_partkey) <= floor(count(*) OVER (PARTITION BY g) * 0.2e0 + 0.5) is_test FROM
 (SELECT p_partkey, if(count(*) OVER (PARTITION BY p_type, floor(p_size / 10)) < 2, 'rare', p_type || floor(p_size / 10)) g FROM part)""")
op("stratified_folds", lambda s, d: X.stratified_folds(table(s, d, "part"), "p_partkey", ["p_type"]).select("p_partkey", "fold"),
   "SELECT p_partkey, ((row_number() OVER (PARTITION BY p_type ORDER BY md5(p_partkey || 'fold42'), p_partkey) - 1) % 5)::INT fold FROM part")


# ---- evaluation on a deterministic prediction table ----------------------------------------------------------
def preds(s, d):
    g = wh(s, d).gold.filter("price_usd > 0 AND id IS NOT NULL")
    return g.select(F.col("id").alias("listing_id"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("model"), "city", "room_type", "host_is_superhost",
                    F.log1p("price_usd").alias("y"), (F.log1p("price_usd") + (F.col("id") % 17 - 8) / 40.0).alias("yhat"))


PR = {"pred": """SELECT id listing_id, if(id % 2 = 0, 'even', 'odd') model, city, room_type, host_is_superhost, price_usd truth, greatest(exp(ln(1 + price_usd) + (id % 17 - 8) / 40e0) - 1, 0) guess,
 price_usd - greatest(exp(ln(1 + price_usd) + (id % 17 - 8) / 40e0) - 1, 0) res FROM gold WHERE price_usd > 0 AND id IS NOT NULL"""}
_MET = (f"count(*) n_samples, {R('avg(abs(res))', 6)} mae, {R('sqrt(avg(res * res))', 6)} rmse, {R('avg(abs(res) / truth) FILTER (truth > 1) * 100', 6)} mape, "
        f"{R('1 - sum(res * res) / (var_pop(truth) * count(*))', 6)} r2, {R('median(abs(res))', 6)} median_ae")
op("regression_metrics", lambda s, d: E.metrics(preds(s, d)), f"SELECT model, {_MET} FROM pred GROUP BY 1", PR)
op("cv_summary", lambda s, d: E.cv_summary(E.metrics(preds(s, d).withColumn("fold", F.col("listing_id") % 5), ["model", "fold"])).select("model", "mae_mean", "mae_std", "r2_mean", "r2_std"),
   f"SELECT model, {R('avg(a)', 6)} mae_mean, {R('stddev_pop(a)', 6)} mae_std, {R('avg(r)', 6)} r2_mean, {R('stddev_pop(r)', 6)} r2_std FROM (SELECT model, listing_id % 5 f, avg(abs(res)) a, "
   "1 - sum(res * res) / (var_pop(truth) * count(*)) r FROM pred GROUP BY 1, 2) GROUP BY 1", PR)
op("compare_models", lambda s, d: E.compare_models(E.metrics(preds(s, d))).select("model", "mae"), f"SELECT model, {R('avg(abs(res))', 6)} mae FROM pred GROUP BY 1", PR)
op("check_targets", lambda s, d: E.check_targets(E.metrics(preds(s, d)), {"mae": 200.0, "mape": 8.0, "r2": 0.55}),
   "SELECT model, avg(abs(res)) <= 200 mae_ok, avg(abs(res) / truth) * 100 <= 8 mape_ok, 1 - sum(res * res) / (var_pop(truth) * count(*)) >= 0.55 r2_ok FROM pred GROUP BY 1", PR)
_RK = {**PR, "rk": "SELECT rank() OVER (ORDER BY abs(res)) + (count(*) OVER (PARTITION BY abs(res)) - 1) / 2e0 a, rank() OVER (ORDER BY guess) + (count(*) OVER (PARTITION BY guess) - 1) / 2e0 b FROM pred",
       "mm": "SELECT avg(res) mu, stddev_pop(res) sd FROM pred"}
op("residual_diagnostics", lambda s, d: E.residual_diagnostics(preds(s, d)).drop("jarque_bera", "normality_p", "hetero_rho"),
   f"SELECT {R('max(mu)', 6)} mean_residual, {R('max(sd)', 6)} std_residual, {R('avg(pow((res - mu) / sd, 3))', 6)} skewness, {R('avg(pow((res - mu) / sd, 4)) - 3', 6)} kurtosis FROM pred, mm", _RK)
op("residual_spread_test", lambda s, d: E.residual_diagnostics(preds(s, d)).select(F.round("hetero_rho", 3).alias("hetero_rho")))
_DIMS = ["city", "room_type", "host_is_superhost"]
op("stratified_errors", lambda s, d: E.stratified_errors(preds(s, d), _DIMS),
   " UNION ALL ".join(f"SELECT '{c}' dimension, {c}::VARCHAR AS \"group\", count(*) n, {R('avg(abs(res))', 6)} mae, {R('avg(abs(res) / truth) FILTER (truth > 1) * 100', 6)} mape, "
                      f"{R('avg(res)', 6)} mean_residual, {R('median(res)', 6)} median_residual FROM pred WHERE {c} IS NOT NULL GROUP BY 2 HAVING count(*) >= 30" for c in _DIMS), PR)
op("interval_quality", lambda s, d: E.interval_quality(preds(s, d).withColumn("lower", F.col("yhat") - 0.11).withColumn("upper", F.col("yhat") + 0.11)),
   f"SELECT count(*) n_samples, {R('count(*) FILTER (truth BETWEEN (guess + 1) * exp(-0.11e0) - 1 AND (guess + 1) * exp(0.11e0) - 1) * 1e0 / count(*)', 6)} coverage, "
   f"{R('avg((guess + 1) * (exp(0.11e0) - exp(-0.11e0)))', 6)} mean_width, {R('median((guess + 1) * (exp(0.11e0) - exp(-0.11e0)))', 6)} median_width FROM pred", PR)
from .stats_queries import _boot  # noqa: E402

_GB = {**PR, "lg": " UNION ALL ".join(f"SELECT '{c}' dimension, {c}::VARCHAR grp, listing_id, res FROM pred WHERE {c} IS NOT NULL" for c in _DIMS)}
op("group_bias", lambda s, d: E.group_bias(preds(s, d), _DIMS).select("dimension", "group", "n", "mean_residual", "ci_lower", "ci_upper", "is_significant"),
   f"SELECT dimension, grp AS \"group\", n, {R('m', 4)} mean_residual, {R('lo', 4)} ci_lower, {R('hi', 4)} ci_upper, lo > 0 OR hi < 0 is_significant FROM "
   "(SELECT dimension, grp, count(*) n, avg(res) m FROM lg GROUP BY 1, 2 HAVING count(*) >= 10) JOIN cis USING (dimension, grp)",
   {**_GB, **_boot(["dimension", "grp"], "lg", 5_000, "res")}, digits=4)
op("group_bias_effects", lambda s, d: E.group_bias(preds(s, d), _DIMS).select("dimension", "group", "n", "mean_residual", "cohens_d", "direction"),
   " UNION ALL ".join(f"SELECT '{c}' dimension, {c}::VARCHAR AS \"group\", count(*) n, {R('avg(res)', 6)} mean_residual, "
                      f"{R('(avg(res) - any_value(am)) / sqrt(((count(*) - 1) * var_samp(res) + (any_value(an) - 1) * any_value(av)) / (count(*) + any_value(an) - 2))', 6)} cohens_d, "
                      f"if(avg(res) > 0, 'under-predicted', 'over-predicted') direction FROM pred, (SELECT count(*) an, avg(res) am, var_samp(res) av FROM pred) "
                      f"WHERE {c} IS NOT NULL GROUP BY 2 HAVING count(*) >= 10" for c in _DIMS), PR)
_BIAS = {"bias": "SELECT o_custkey, count(*) % 3 = 0 sig, count(*) % 5 = 0 lg FROM orders GROUP BY 1"}
op("fairness_summary", lambda s, d: E.fairness_summary(table(s, d, "orders").groupBy("o_custkey").agg(rows().alias("n")).select(
    F.lit("city").alias("dimension"), (F.col("n") % 3 == 0).alias("is_significant"), F.when(F.col("n") % 5 == 0, "large").otherwise("small").alias("magnitude"))).select(
    "groups_tested", "significant_biases", "large_biases", "geographic_bias", "overall_risk"),
   "SELECT count(*) groups_tested, count(*) FILTER (sig) significant_biases, count(*) FILTER (sig AND lg) large_biases, true geographic_bias, "
   "CASE WHEN count(*) FILTER (sig AND lg) >= 3 OR count(*) FILTER (sig) >= count(*) * 0.4 THEN 'HIGH' WHEN count(*) FILTER (sig AND lg) >= 1 OR count(*) FILTER (sig) >= count(*) * 0.2 THEN 'MEDIUM' ELSE 'LOW' END overall_risk FROM bias", _BIAS)
op("attribution_importance", lambda s, d: A.importance(_derived_attribution(s, d), ["city"], top=3),
   f"SELECT city, feature, {R('m', 6)} mean_abs, rank FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY m DESC, feature)::INT AS rank FROM (SELECT city, feature, avg(abs(a)) m FROM attrib GROUP BY 1, 2)) WHERE rank <= 3",
   {"attrib": " UNION ALL ".join(f"SELECT city, '{c}' feature, {c} - (SELECT avg({c}) FROM gold) a FROM gold WHERE id IS NOT NULL" for c in ("accommodates", "bedrooms", "beds", "amenity_count"))})


def _derived_attribution(s, d):
    g = wh(s, d).gold
    cols = ["accommodates", "bedrooms", "beds", "amenity_count"]
    mu = g.agg(*[F.avg(c).alias(c) for c in cols]).first()
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) - F.lit(mu[c])).alias("attribution")) for c in cols])
    return g.filter("id IS NOT NULL").select(F.col("id").alias("listing_id"), "city", F.inline(cells))


# ---- models (rows-only) ---------------------------------------------------------------------------
_cache: dict = {}
MATRIX_ROWS_PER_TASK = 50_000


def _matrix(s, d):
    key = (s.sparkContext.applicationId, d)
    if key not in _cache:
        df, names = X.feature_matrix(wh(s, d).star)
        df = X.stratified_folds(X.stratified_split(df, "listing_id", ["meta_city", "meta_price_quintile"]), "listing_id", ["meta_price_quintile"])
        # the strata leave few tasks, one for each price quintile; every fit below reads these rows many times
        tasks = max(2 * s.sparkContext.defaultParallelism, -(-row_bound(wh(s, d).star, "fact_listing_snapshot") // MATRIX_ROWS_PER_TASK))
        df = checkpointed(df.repartition(tasks, "listing_id"))
        _cache[key] = (df, names, M.training_table(df, names))
    return _cache[key]


def _train(s, d):
    return _matrix(s, d)[2].filter(~F.col("is_test"))


def _test(s, d):
    return _matrix(s, d)[2].filter("is_test")


def _ridge(s, d):
    return M.estimator("ridge", regParam=0.1).fit(_train(s, d))


META = ["listing_id", "meta_city", "meta_room_type", "meta_price_quintile", "meta_has_reviews", "meta_is_professional_host"]
op("ridge_model", lambda s, d: E.metrics(M.predict(_ridge(s, d), _test(s, d), META, "ridge")))
def _forest(s, d):
    key = (s.sparkContext.applicationId, d, "forest")
    if key not in _cache:
        _cache[key] = M.estimator("random_forest", **{k: v[0] for k, v in settings.MODELS["random_forest"]["grid"].items()}).fit(_train(s, d))
    return _cache[key]


op("random_forest_model", lambda s, d: E.metrics(M.predict(_forest(s, d), _test(s, d), META, "random_forest")))
op("boosted_model", lambda s, d: E.metrics(M.predict(M.estimator("lightgbm", **{k: v[0] for k, v in settings.MODELS["lightgbm"]["grid"].items()}).fit(_train(s, d)),
                                                     _test(s, d), META, "lightgbm")))
op("grid_search", lambda s, d: G.grid_scores(_train(s, d), settings.MODELS["ridge"]["grid"]["regParam"]))
op("cross_validation", lambda s, d: G.cross_validate(_train(s, d), 0.1))
# one feature, where sums give the fit in SQL: slope = covariance / variance * n / (n + alpha)
_ONE = {"pts": "SELECT l_orderkey % 5 fold, l_quantity::DOUBLE x, ln(1 + l_extendedprice) y FROM lineitem",
        "sf": "SELECT fold, count(*)::DOUBLE n, sum(x) sx, sum(x * x) sxx, sum(y) sy, sum(x * y) sxy FROM pts GROUP BY 1",
        "rest": "SELECT f.fold, sum(o.n) n, sum(o.sx) sx, sum(o.sxx) sxx, sum(o.sy) sy, sum(o.sxy) sxy FROM sf f JOIN sf o ON o.fold <> f.fold GROUP BY 1",
        "fits": f"SELECT fold, alpha, sx / n mx, sy / n my, (sxy - sx * sy / n) / (sxx - sx * sx / n) * n / (n + alpha) b FROM rest, (SELECT unnest({settings.MODELS['ridge']['grid']['regParam']!r}::DOUBLE[]) alpha)",
        "oof": "SELECT p.fold, alpha, y, my + b * (x - mx) yhat FROM pts p JOIN fits USING (fold)"}


def _points(s, d):
    return table(s, d, "lineitem").select((F.col("l_orderkey") % 5).alias("fold"), F.col("l_quantity").cast("double").alias("x"), F.log1p("l_extendedprice").alias("target"))


op("grid_search_one_feature", lambda s, d: G.grid_scores(_points(s, d), settings.MODELS["ridge"]["grid"]["regParam"], ["x"]),
   f"SELECT alpha, {R('avg(m)', 6)} mae FROM (SELECT alpha, fold, avg(abs(y - yhat)) m FROM oof GROUP BY 1, 2) GROUP BY 1", _ONE)
op("cross_validation_one_feature", lambda s, d: G.cross_validate(_points(s, d), 10.0, features=["x"]).select("fold", "n_samples", "mae", "rmse", "mape", "r2"),
   f"SELECT fold, count(*) n_samples, {R('avg(abs(t - g))', 4)} mae, {R('sqrt(avg((t - g) ** 2))', 4)} rmse, {R('avg(abs(t - g) / t) FILTER (t > 1) * 100', 4)} mape, "
   f"{R('1 - sum((t - g) ** 2) / (var_pop(t) * count(*))', 4)} r2 FROM (SELECT fold, exp(y) - 1 t, greatest(exp(yhat) - 1, 0) g FROM oof WHERE alpha = 10) GROUP BY 1", _ONE, digits=4)


def _experiment(s, d):
    from .operator_queries import _scratch
    result = M.train_experiment(_train(s, d))
    root = M.save_experiment(result, _scratch(s, d, "models"))
    again = M.load_model(root, result["best"])
    return E.metrics(M.predict(again, _test(s, d), META, result["best"]))


op("train_experiment", _experiment)


def _interval(s, d):
    key = (s.sparkContext.applicationId, d, "bounds")
    if key not in _cache:
        _cache[key] = fit_quantile_trees(_train(s, d))
    low, high = (_cache[key][q] for q in settings.QUANTILES)
    return low, high, M.predict_interval(low, high, _test(s, d), META)


op("quantile_models", lambda s, d: E.interval_quality(_interval(s, d)[2]))
op("evaluate_models", lambda s, d: E.stratified_errors(M.predict(_ridge(s, d), _test(s, d), META, "ridge"), ["meta_city", "meta_room_type", "meta_price_quintile"], min_rows=10))
op("leave_area_out", lambda s, d: G.leave_group_out(_matrix(s, d)[2], 0.1, min_rows=30))
_LAO = {**feat("fr", "tr"), "pa": "SELECT city, neighbourhood_group g, target y, coalesce(accommodates, 0)::DOUBLE x FROM tr WHERE city IS NOT NULL",
        "sa": "SELECT city, g, count(*)::DOUBLE n, sum(x) sx, sum(x * x) sxx, sum(y) sy, sum(x * y) sxy FROM pa GROUP BY 1, 2",
        "ra": "SELECT s.city, s.g, c.n - s.n n, c.sx - s.sx sx, c.sxx - s.sxx sxx, c.sy - s.sy sy, c.sxy - s.sxy sxy FROM sa s JOIN (SELECT city, sum(n) n, sum(sx) sx, sum(sxx) sxx, sum(sy) sy, sum(sxy) sxy FROM sa GROUP BY 1) c "
              "USING (city) WHERE s.g IS NOT NULL AND s.n >= 30 AND c.n - s.n >= 30",
        "oa": "SELECT p.city, p.g, r.n, exp(y) - 1 t, greatest(exp(sy / n + (sxy - sx * sy / n) / (sxx - sx * sx / n) * n / (n + 10) * (x - sx / n)) - 1, 0) h FROM pa p JOIN ra r ON p.city = r.city AND p.g = r.g"}
op("leave_area_out_one_feature", lambda s, d: G.leave_group_out(X.with_target(X.feature_rows(wh(s, d).star)), 10.0, "city", "neighbourhood_group", ["accommodates"]).drop("gap_vs_cv"),
   f"SELECT city, g neighbourhood_group, max(n)::BIGINT n_train, count(*) n_test, {R('avg(abs(t - h))', 6)} mae, {R('avg(abs(t - h) / t) FILTER (t > 1) * 100', 6)} mape, {R('avg(t - h)', 6)} mean_residual FROM oa GROUP BY 1, 2", _LAO)
op("city_transfer", lambda s, d: M.city_transfer(M.estimator("ridge", regParam=0.1), _matrix(s, d)[0], _matrix(s, d)[1]))
op("area_ablation", lambda s, d: M.area_ablation(M.estimator("ridge", regParam=0.1), _matrix(s, d)[0], _matrix(s, d)[1]))
op("explain_linear", lambda s, d: A.importance(A.linear_attribution(_ridge(s, d), _matrix(s, d)[0], _matrix(s, d)[1])))
op("explain_trees", lambda s, d: _explained(s, d)["importance"])


def _explained(s, d):
    """The explanation job of the forest, whose stored values and reports its queries share."""
    from .operator_queries import _scratch
    key = (s.sparkContext.applicationId, d, "explained")
    if key not in _cache:
        matrix, names, rows_ = _matrix(s, d)
        _cache[key] = A.explain(_forest(s, d), matrix, names, M.predict(_forest(s, d), rows_, ["listing_id"]), _scratch(s, d, "explained"))
    return _cache[key]


def _adding_up(s, d, model, values, base):
    """Rows explained, and rows whose values do not add up to prediction minus mean."""
    total = values.groupBy("listing_id").agg(F.sum("attribution").alias("t"), rows().alias("n"))
    off = (F.abs(F.col("t") + F.lit(base) - F.col("yhat")) > 1e-8) | F.col("t").isNull() | (F.col("n") != len(_matrix(s, d)[1]))
    return M.predict(model, _matrix(s, d)[2], ["listing_id"]).join(total, "listing_id", "left").agg(rows().alias("rows_explained"), F.count_if(off).alias("rows_off"))


op("explain_trees_adds_up", lambda s, d: _adding_up(s, d, _forest(s, d), _explained(s, d)["values"], A.expected_value(_forest(s, d), s)),
   "SELECT count(*) rows_explained, 0::BIGINT rows_off FROM qt", feat("fr", "tr", "qt"))
op("explain_bounds_adds_up", lambda s, d: _adding_up(s, d, _interval(s, d)[1], A.tree_attribution(_interval(s, d)[1], *_matrix(s, d)[:2]), A.expected_value(_interval(s, d)[1], s)),
   "SELECT count(*) rows_explained, 0::BIGINT rows_off FROM qt", feat("fr", "tr", "qt"))
op("explain_trees_by_city", lambda s, d: _explained(s, d)["importance_by_city"])
op("explain_trees_cases", lambda s, d: A.explain_cases(_forest(s, d), *_matrix(s, d)[:2], M.predict(_forest(s, d), _matrix(s, d)[2], ["listing_id"])))


def _local(s, d):
    model = _ridge(s, d)
    return A.explain_cases(model, _matrix(s, d)[0], _matrix(s, d)[1], M.predict(model, _matrix(s, d)[2], ["listing_id"]))


op("explain_cases", _local)
op("batch_scoring", lambda s, d: M.score_prices(_ridge(s, d), _matrix(s, d)[0].select("listing_id", "accommodates", "bedrooms", "bathrooms"), _matrix(s, d)[1]))


def _audit(s, d):
    dimensions = [f"meta_{c}" for c in settings.BIAS_DIMENSIONS]
    pred = M.predict(_ridge(s, d), _test(s, d), ["listing_id", *dimensions], "ridge")
    return E.fairness_summary(E.group_bias(pred, dimensions))


op("bias_audit", _audit)
