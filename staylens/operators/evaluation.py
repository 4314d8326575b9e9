"""Evaluation of predictions: metrics, residuals, errors by group, intervals, group bias, fairness.

All functions read one prediction table: row key, true value ``y``, prediction ``yhat`` (log scale by default)
and any grouping columns.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions.rounding import ratio, rows
from . import stats as S
from .features import from_target
from .ordering import join_groups, medians


def on_price_scale(df: DataFrame, log_target: bool = True) -> DataFrame:
    """Adds ``truth``, ``guess`` (not below 0) and ``residual``."""
    truth = F.expm1("y") if log_target else F.col("y")
    guess = from_target("yhat") if log_target else F.greatest(F.col("yhat"), F.lit(0.0))
    return df.withColumn("truth", truth.cast("double")).withColumn("guess", guess.cast("double")).withColumn(
        "residual", F.col("truth") - F.col("guess"))


def _metric_columns() -> dict[str, Column]:
    e = F.abs("residual")
    return {"mae": F.avg(e), "rmse": F.sqrt(F.avg(F.col("residual") * F.col("residual"))),
            "mape": F.avg(F.when(F.col("truth") > 1.0, e / F.col("truth"))) * 100}


def metrics(df: DataFrame, by: list[str] = ["model"], log_target: bool = True) -> DataFrame:
    """MAE, RMSE, MAPE (true values above 1), R² and median absolute error per group."""
    src = on_price_scale(df, log_target)
    sse, sst = F.sum(F.col("residual") * F.col("residual")), F.var_pop("truth") * F.count("truth")
    out = src.groupBy(*by).agg(rows().alias("n_samples"), *[c.alias(n) for n, c in _metric_columns().items()],
                               (F.lit(1.0) - ratio(sse, sst)).alias("r2"))
    return join_groups(out, medians(src, by, {"median_ae": F.abs("residual")}), by)


def cv_summary(fold_metrics: DataFrame, by: list[str] = ["model"]) -> DataFrame:
    """Mean and population spread of each metric over folds."""
    names = ["mae", "rmse", "mape", "r2", "median_ae"]
    return fold_metrics.groupBy(*by).agg(*[e for n in names for e in (F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std"))])


def compare_models(table: DataFrame) -> DataFrame:
    return table.orderBy("mae", "model")


def check_targets(table: DataFrame, targets: dict[str, float] = settings.TARGETS) -> DataFrame:
    """Whether each model meets each target: errors at most, R² at least."""
    checks = [((F.col(k) >= v) if k == "r2" else (F.col(k) <= v)) for k, v in targets.items()]
    return table.select("model", *[F.coalesce(c, F.lit(False)).alias(f"{k}_ok") for k, c in zip(targets, checks)])


def residual_diagnostics(df: DataFrame, log_target: bool = True) -> DataFrame:
    """Mean, spread, population skewness and kurtosis, Jarque-Bera, and rank correlation of error size and guess."""
    src = on_price_scale(df, log_target)
    r = F.col("residual")
    jb = rows() / 6.0 * (F.pow(F.skewness(r), 2) + F.pow(F.kurtosis(r), 2) / 4)
    out = src.agg(F.avg(r).alias("mean_residual"), F.stddev_pop(r).alias("std_residual"), F.skewness(r).alias("skewness"),
                  F.kurtosis(r).alias("kurtosis"), jb.alias("jarque_bera"), F.exp(-jb / 2).alias("normality_p"))
    rho = S.spearman(src.select(F.abs(r).alias("size"), "guess"), ["size", "guess"]).select("rho").scalar()
    return out.withColumn("hetero_rho", rho)


def _by_dimension(df: DataFrame, dimensions: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("group")) for d in dimensions if d in df.columns])
    return df.select("truth", "guess", "residual", F.inline(cells)).filter("group IS NOT NULL")


def stratified_errors(df: DataFrame, dimensions: list[str], min_rows: int = 30, log_target: bool = True) -> DataFrame:
    """Errors per value of every dimension, in one pass over the rows."""
    long, keys = _by_dimension(on_price_scale(df, log_target), dimensions), ["dimension", "group"]
    m = _metric_columns()
    out = long.groupBy(*keys).agg(rows().alias("n"), m["mae"].alias("mae"), m["mape"].alias("mape"), F.avg("residual").alias("mean_residual"))
    out = out.filter(F.col("n") >= min_rows)
    return join_groups(out, medians(long, keys, {"median_residual": "residual"}), keys)


def interval_quality(df: DataFrame, lower: str = "lower", upper: str = "upper", log_target: bool = True) -> DataFrame:
    """Share of true values inside the interval, and its width."""
    def scale(c):
        return from_target(c) if log_target else F.greatest(F.col(c), F.lit(0.0))
    src = df.select((F.expm1("y") if log_target else F.col("y")).alias("truth"), scale(lower).alias("lo"), scale(upper).alias("hi"))
    inside = F.col("truth").between(F.col("lo"), F.col("hi"))
    out = src.agg(rows().alias("n_samples"), ratio(F.count_if(inside), rows()).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("mean_width"))
    return join_groups(out, medians(src, [], {"median_width": F.col("hi") - F.col("lo")}), [])


def group_bias(df: DataFrame, dimensions: list[str] = settings.BIAS_DIMENSIONS, key: str = "listing_id", resamples: int = 5_000,
               min_rows: int = 10, log_target: bool = True) -> DataFrame:
    """Mean residual per group with bootstrap interval, effect size against all residuals, and direction."""
    src = on_price_scale(df, log_target)
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("group")) for d in dimensions if d in df.columns])
    long = src.select(key, "residual", F.inline(cells)).filter("group IS NOT NULL")
    keys = ["dimension", "group"]
    m = long.groupBy(*keys).agg(rows().alias("n"), F.avg("residual").alias("mean_residual"), F.var_samp("residual").alias("var"))
    m = m.filter(F.col("n") >= min_rows)
    ci = S.bootstrap_mean(long, keys, "residual", key, resamples).select(*keys, "ci_lower", "ci_upper")
    whole = src.agg(F.count("residual").alias("_n"), F.avg("residual").alias("_m"), F.var_samp("residual").alias("_v"))
    total = {c: whole.select(c).scalar() for c in whole.columns}
    d = S.cohens_d_from("n", "mean_residual", "var", total["_n"], total["_m"], total["_v"])
    return join_groups(m, ci, keys).select(
        *keys, "n", "mean_residual", "ci_lower", "ci_upper",
        ((F.col("ci_lower") > 0) | (F.col("ci_upper") < 0)).alias("is_significant"),
        d.alias("cohens_d"), S.magnitude(d, S.COHEN).alias("magnitude"),
        F.when(F.col("mean_residual") > 0, "under-predicted").otherwise("over-predicted").alias("direction"))


def fairness_summary(bias: DataFrame) -> DataFrame:
    """Overall risk from the number and size of significant biases; no groups means low risk.

    Dimensions go by their own names or by those of the matrix's columns, ``meta_`` in front.
    """
    bias = bias.withColumn("dimension", F.regexp_replace("dimension", "^meta_", ""))
    sig = F.count_if("is_significant")
    large = F.count_if(F.col("is_significant") & F.col("magnitude").isin("medium", "large"))
    out = bias.agg(rows().alias("groups_tested"), sig.alias("significant_biases"), large.alias("large_biases"),
                   F.bool_or(F.col("is_significant") & F.col("dimension").isin("city", "neighbourhood_group")).alias("geographic_bias"),
                   F.bool_or(F.col("is_significant") & (F.col("dimension") == "price_quintile")).alias("price_range_bias"),
                   F.bool_or(F.col("is_significant") & (F.col("dimension") == "has_reviews")).alias("cold_start_bias"))
    n, s, big = F.col("groups_tested"), F.col("significant_biases"), F.col("large_biases")
    risk = (F.when(n == 0, "LOW").when((big >= 3) | (s >= n * 0.4), "HIGH").when((big >= 1) | (s >= n * 0.2), "MEDIUM").otherwise("LOW"))
    flags = ["geographic_bias", "price_range_bias", "cold_start_bias"]
    return out.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags}).withColumn("overall_risk", risk)


def top_biases(bias: DataFrame, top: int = 5) -> DataFrame:
    return bias.filter("is_significant").orderBy(F.desc(F.abs("cohens_d")), "dimension", "group").limit(top)
