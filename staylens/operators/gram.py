"""Ridge regression from mergeable cross-product matrices: every penalty, fold and left-out group from one scan.

A group's matrix A'A of A = [1, x, y] holds all that a linear fit needs, and matrices add up: the model without a fold or an
area follows from the total minus that group's matrix.  So tuning, cross-validation and leave-one-group-out take one scan
for the matrices and one for the predictions, whatever the number of penalties, folds and groups, and small solves
between.  Each task sends one matrix per group it meets (flushed beyond ``HELD_GROUPS``); matrices of a group are added as they
stream by, so a popular group needs no more memory than a rare one.

The penalty is ``alpha`` times the squared weights of standardised features beside the sum of squared errors; the intercept
is free.  A feature without spread gets weight 0.
"""

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evaluation as E
from .joins import small_side
from .ordering import checkpointed

HELD_GROUPS = 500
_ALL = "_everything"


def _inputs(df: DataFrame, features: str | list[str]) -> Column:
    """The features as an array: a vector column, or plain columns with missing values as 0."""
    if isinstance(features, str):
        return vector_to_array(F.col(features))
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])


def _packed(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(len(m))]


def unpacked(values) -> np.ndarray:
    """The symmetric matrix of a packed upper triangle."""
    size = int((np.sqrt(8 * len(values) + 1) - 1) / 2)
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = values
    return out + np.triu(out, 1).T


def _summed(parts: DataFrame, by: list[str]) -> DataFrame:
    """Adds the matrices of each group while the sorted rows stream by."""
    def run(batches):
        key, total = None, None
        for b in batches:
            keys = list(zip(*[b[c] for c in by]))
            out = []
            for k, m in zip(keys, b["matrix"]):
                k = tuple(None if x is None or x != x else x for x in k)
                if k == key:
                    total = total + np.asarray(m)
                else:
                    if total is not None:
                        out.append((*key, total))
                    key, total = k, np.asarray(m)
            if out:
                yield pd.DataFrame(out, columns=[*by, "matrix"])
        if total is not None:
            yield pd.DataFrame([(*key, total)], columns=[*by, "matrix"])

    names = ", ".join(f"`{c}` string" for c in by)
    return parts.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, f"{names}, matrix array<double>")


def cross_products(df: DataFrame, by: list[str], features: str | list[str] = "features", target: str = "target") -> DataFrame:
    """One packed matrix of [1, features, target] per group of ``by``; rows without a target do not count.

    Group columns come back as text, a missing value as null; ``matrix[0]`` is the number of rows.
    """
    src = df.filter(F.col(target).isNotNull()).select(
        *[F.col(f"`{c}`").cast("string").alias(c) for c in by], _inputs(df, features).alias("_x"), F.col(target).cast("double").alias("_y"))
    src, keys = (src, by) if by else (src.withColumn(_ALL, F.lit("")), [_ALL])

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def flush():
            out = pd.DataFrame([(*k, _packed(m)) for k, m in held.items()], columns=[*keys, "matrix"])
            held.clear()
            return out

        for b in batches:
            if not len(b):
                continue
            a = np.column_stack([np.ones(len(b)), np.stack(b["_x"].to_numpy()), b["_y"].to_numpy(float)])
            code = np.zeros(len(b), np.int64)
            for c in keys:
                part, values = pd.factorize(b[c])
                code = pd.factorize(code * (len(values) + 1) + part)[0]
            order = np.argsort(code, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                k = tuple(b[c].iloc[rows[0]] for c in keys)
                k = tuple(None if x is None or x != x else x for x in k)
                m = a[rows].T @ a[rows]
                held[k] = held[k] + m if k in held else m
            if len(held) > HELD_GROUPS:
                yield flush()
        if held:
            yield flush()

    names = ", ".join(f"`{c}` string" for c in keys)
    return _summed(src.mapInPandas(run, f"{names}, matrix array<double>"), keys)


def merged(products: DataFrame, by: list[str]) -> DataFrame:
    """The matrices of coarser groups."""
    src, keys = (products, by) if by else (products.withColumn(_ALL, F.lit("")), [_ALL])
    return _summed(src.select(*keys, "matrix"), keys)


def solve(matrix: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights, on the scale of the features, from a square matrix of [1, x, y]."""
    n, p = matrix[0, 0], len(matrix) - 2
    mean, ybar = matrix[0, 1:p + 1] / n, matrix[0, p + 1] / n
    xx = matrix[1:p + 1, 1:p + 1] - n * np.outer(mean, mean)
    xy = matrix[1:p + 1, p + 1] - n * mean * ybar
    spread = np.sqrt(np.maximum(np.diag(xx), 0) / n)
    # sums of squares of a constant differ from zero by rounding only
    used = spread > 1e-9 * np.sqrt(np.maximum(np.diag(matrix)[1:p + 1] / n, 1e-300))
    s = spread[used]
    weights = np.zeros(p)
    if used.any():
        z = xx[np.ix_(used, used)] / np.outer(s, s) + alpha * np.eye(len(s))
        zy = xy[used] / s
        try:
            found = np.linalg.solve(z, zy)
        except np.linalg.LinAlgError:
            found = np.linalg.lstsq(z, zy, rcond=None)[0]
        weights[used] = found / s
    return float(ybar - mean @ weights), weights


def penalty(matrix: np.ndarray, reg_param: float) -> float:
    """The alpha under which ``solve`` gives MLlib's fit of this ``regParam``: that one weighs it against the mean squared error of a
    target brought to spread 1."""
    n, total, squares = matrix[0, 0], matrix[0, -1], matrix[-1, -1]
    spread = np.sqrt(max(squares / n - (total / n) ** 2, 0.0))
    return reg_param * n / spread if spread > 0 else reg_param * n


def _scored(x: Column, intercept: Column, weights: Column) -> Column:
    return intercept + F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def out_of_fold(data: DataFrame, alphas: list[float], keep: list[str] = [], features: str | list[str] = "features", target: str = "target",
                fold: str = "fold", as_reg_param: bool = False) -> DataFrame:
    """(*keep, fold, alpha, y, yhat): every row's prediction by the model of each penalty that did not see its fold.

    With ``as_reg_param`` the penalties are MLlib's ``regParam``, see ``penalty``.  Two scans.  The driver sees one matrix per fold; fold numbers are few by their meaning.
    """
    grams = {r[fold]: unpacked(r.matrix) for r in cross_products(data, [fold], features, target).collect()}
    total = sum(grams.values())
    models = [(k, float(a), *solve(total - m, penalty(total - m, a) if as_reg_param else a)) for k, m in grams.items() for a in alphas if (total - m)[0, 0] >= 1]
    spark = data.sparkSession
    table = spark.createDataFrame([(k, a, b, w.tolist()) for k, a, b, w in models], "_k string, alpha double, _b double, _w array<double>")
    src = data.select(*keep, F.col(fold), F.col(target).alias("y"), _inputs(data, features).alias("_x"), F.col(fold).cast("string").alias("_k"))
    return src.join(F.broadcast(table), "_k").select(*keep, fold, "alpha", "y", _scored(F.col("_x"), F.col("_b"), F.col("_w")).alias("yhat"))


def grid_scores(data: DataFrame, alphas: list[float], features: str | list[str] = "features", target: str = "target", fold: str = "fold",
                as_reg_param: bool = False) -> DataFrame:
    """(alpha, mae): mean over folds of the mean absolute error on the target's scale."""
    each = out_of_fold(data, alphas, [], features, target, fold, as_reg_param).groupBy("alpha", fold).agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("m"))
    return each.groupBy("alpha").agg(F.avg("m").alias("mae"))


def best_alpha(data: DataFrame, alphas: list[float], features: str | list[str] = "features", target: str = "target", fold: str = "fold",
               as_reg_param: bool = False) -> float:
    """The penalty with the smallest error, the smallest of equals."""
    return grid_scores(data, alphas, features, target, fold, as_reg_param).orderBy("mae", "alpha").first().alpha


def cross_validate(data: DataFrame, alpha: float, name: str = "ridge", features: str | list[str] = "features", target: str = "target",
                   fold: str = "fold", as_reg_param: bool = False) -> DataFrame:
    """Metrics per fold on the price scale."""
    preds = out_of_fold(data, [alpha], [], features, target, fold, as_reg_param).withColumnRenamed(fold, "fold")
    return E.metrics(preds.withColumn("model", F.lit(name)), ["model", "fold"])


def leave_group_out(data: DataFrame, alpha: float, city: str = "meta_city", group: str = "meta_neighbourhood_group", features: str | list[str] = "features",
                    target: str = "target", min_rows: int = 30, baseline_mae: float = 0.0) -> DataFrame:
    """Errors on each area group of a city from the ridge model of the city's other rows, those without a group among them.

    Any number of groups: a group's model is solved in a task from the city's matrix minus its own, and meets the group's
    rows in a join.  Groups need ``min_rows`` rows themselves and in the rest of the city.
    """
    products = checkpointed(cross_products(data.filter(F.col(city).isNotNull()), [city, group], features, target))
    whole = merged(products, [city]).withColumnRenamed("matrix", "_total")
    pairs = products.filter(F.col(group).isNotNull() & (F.col("matrix")[0] >= min_rows)).join(whole, city)
    pairs = pairs.filter(F.col("_total")[0] - F.col("matrix")[0] >= min_rows)

    def run(batches):
        for b in batches:
            rows = []
            for c, g, m, t in zip(b[city], b[group], b["matrix"], b["_total"]):
                rest = unpacked(np.asarray(t) - np.asarray(m))
                rows.append((c, g, *solve(rest, alpha), int(round(rest[0, 0]))))
            yield pd.DataFrame(rows, columns=["_c", "_g", "_b", "_w", "_n"])

    models = pairs.mapInPandas(run, "_c string, _g string, _b double, _w array<double>, _n long")
    src = data.filter(F.col(target).isNotNull()).select(F.col(city).cast("string").alias("_c"), F.col(group).cast("string").alias("_g"),
                                                        F.col(target).alias("y"), _inputs(data, features).alias("_x"))
    # checkpointed, so that counting them for the join does not solve twice
    preds = src.join(small_side(checkpointed(models)), ["_c", "_g"]).select("_c", "_g", "_n", "y", _scored(F.col("_x"), F.col("_b"), F.col("_w")).alias("yhat"))
    scaled = E.on_price_scale(preds)
    e = F.abs("residual")
    return scaled.groupBy(F.col("_c").alias("city"), F.col("_g").alias("neighbourhood_group")).agg(
        F.max("_n").alias("n_train"), F.count(F.lit(1)).alias("n_test"), F.avg(e).alias("mae"),
        (F.avg(F.when(F.col("truth") > 1, e / F.col("truth"))) * 100).alias("mape"), F.avg("residual").alias("mean_residual")
    ).withColumn("gap_vs_cv", F.col("mae") - F.lit(baseline_mae))
