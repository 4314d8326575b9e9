"""Feature attribution: exact Shapley values of linear models and of tree ensembles."""

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .distribution import sample_rows
from .features import from_target
from .joins import small_side
from .ordering import checkpointed, exact_quantiles, shared_folder

MAX_NODES = 2_000_000  # of an ensemble: its leaf table goes to every task
ROWS_AT_ONCE = 256
ROWS_HELD = 20_000  # rows of a task that share one set of pattern tables
LEAVES_AT_ONCE = 256


def _chosen(matrix: DataFrame, rows: DataFrame | None, key: str, sample: int | None) -> DataFrame:
    src = matrix if rows is None else rows
    return src if sample is None else sample_rows(src, key, sample)


def linear_attribution(model, matrix: DataFrame, features: list[str], key: str = "listing_id", sample: int | None = None,
                       extra: list[str] = [], rows: DataFrame | None = None) -> DataFrame:
    """Coefficient x (value - mean): the exact Shapley value of a linear model, one row per key and feature.

    The means are those of all of ``matrix``; explained are all its rows, or ``rows``, or a ``sample`` if asked for.
    """
    means = matrix.agg(*[F.avg(f"`{f}`").alias(f"m{i}") for i, f in enumerate(features)]).first()
    cells = F.array(*[F.struct(F.lit(f).alias("feature"),
                               (F.lit(float(w)) * (F.col(f"`{f}`") - F.lit(means[i]).cast("double"))).alias("attribution"))
                      for i, (f, w) in enumerate(zip(features, model.coefficients))])
    return _chosen(matrix, rows, key, sample).select(key, *extra, F.inline(cells))


@dataclass
class Leaves:
    """Leaves of an ensemble with the same number of distinct path features: arrays of shape (leaf, feature on the path).

    A row reaches a leaf if each of its path features lies in (low, high]; ``share`` is the part of the fitted rows that
    follow all cuts on that feature, given the cuts on the others.
    """
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def tree_nodes(model, spark: SparkSession) -> tuple[list[tuple], list[float], float]:
    """Node table, tree weights and constant of an ensemble: (tree, node, left, right, feature, threshold, value, rows)."""
    if hasattr(model, "nodes"):
        nodes = model.nodes()
        return nodes, [1.0] * (1 + max(n[0] for n in nodes)), model.base
    path = shared_folder(spark, "trees", uuid.uuid4().hex)
    model.write().overwrite().save(path)  # the public form of the trees
    table = spark.read.parquet(f"{path}/data")
    n = table.count()
    if n > MAX_NODES:
        raise ValueError(f"{n} tree nodes, at most {MAX_NODES} are explained")
    if table.filter("nodeData.split.numCategories > 0").limit(1).count():
        raise ValueError("cuts by category are not explained")
    flat = table.select("treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
                        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("t"), "nodeData.prediction",
                        F.element_at("nodeData.impurityStats", 1).alias("rows"))
    weights = [1.0 / len(model.trees)] * len(model.trees) if isinstance(model, RandomForestRegressionModel) else list(model.treeWeights)
    return [tuple(r) for r in flat.collect()], weights, 0.0  # bounded by MAX_NODES


def leaf_table(nodes: list[tuple], weights: list[float], constant: float = 0.0) -> tuple[list[Leaves], float]:
    """Leaves by path length, and the ensemble's mean over the fitted rows."""
    trees: dict = {}
    for t, n, *rest in nodes:
        trees.setdefault(t, {})[n] = rest
    by_size: dict = {}
    mean = constant
    for t, tree in trees.items():
        stack = [(0, {}, 1.0)]
        while stack:
            n, path, reach = stack.pop()
            left, right, f, cut, value, rows = tree[n]
            if left < 0:
                mean += weights[t] * value * reach
                if path and value:
                    by_size.setdefault(len(path), []).append((path, weights[t] * value))
                continue
            for child, goes_left in ((left, True), (right, False)):
                part = tree[child][5] / rows if rows else 0.0
                if f < 0:  # no cut: all rows go left
                    if goes_left:
                        stack.append((child, path, reach))
                    continue
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                low, high = (low, min(high, cut)) if goes_left else (max(low, cut), high)
                stack.append((child, {**path, f: (low, high, share * part)}, reach * part))
    out = []
    for size in sorted(by_size):
        cells = by_size[size]
        column = [np.array([[p[f][k] for f in sorted(p)] for p, _ in cells]) for k in range(3)]
        out.append(Leaves(np.array([sorted(p) for p, _ in cells]), *column, np.array([v for _, v in cells])))
    return out, mean


def shapley_values(x: np.ndarray, table: list[Leaves], width: int) -> np.ndarray:
    """Exact path-dependent Shapley values of rows ``x``, one column per feature.

    For a leaf with value v and path features of which a row meets o_j (0 or 1) and the fitted rows meet the share z_j, the
    value of feature j is v (o_j - z_j) times the integral over t in [0, 1] of the product of t o_i + (1 - t) z_i over the other
    path features: the integral weighs every subset of them as Shapley does.  The integrand is a polynomial of degree d - 1 in t, so
    ceil(d / 2) Gauss points give it exactly, and the work is polynomial in the depth.
    """
    out = np.zeros((len(x), width))
    for leaves in table:
        d = leaves.feature.shape[1]
        points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        points, weights = (points + 1) / 2, weights / 2
        for start in range(0, len(leaves.value), LEAVES_AT_ONCE):
            some = slice(start, start + LEAVES_AT_ONCE)
            f, z = leaves.feature[some], leaves.share[some]
            v = x[:, f]
            # a missing value fails every comparison, so it meets only paths that always go right
            o = (~(v <= leaves.low[some]) & ((v <= leaves.high[some]) | np.isinf(leaves.high[some]))).astype(float)
            total = np.zeros_like(o)
            for t, w in zip(points, weights):
                part = t * o + (1 - t) * z
                before, after = np.ones_like(part), np.ones_like(part)
                for k in range(1, d):
                    before[:, :, k] = before[:, :, k - 1] * part[:, :, k - 1]
                    after[:, :, d - 1 - k] = after[:, :, d - k] * part[:, :, d - k]
                total += w * before * after
            gains = (total * (o - z) * leaves.value[some][None, :, None]).reshape(len(x), -1)
            order = np.argsort(f.ravel(), kind="stable")
            names, first = np.unique(f.ravel()[order], return_index=True)
            out[:, names] += np.add.reduceat(gains[:, order], first, axis=1)
    return out


def _pattern_tables(share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Shapley values of each path feature under every pattern of met features: (feature on the path, leaf, pattern).

    Bit j of a pattern says whether the row meets path feature j.  The product over the other features is that of the
    features before and behind j, each over its own patterns, so a matrix product gives all of them and sums the Gauss points.
    """
    n, d = share.shape
    points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    points, weights = (points + 1) / 2, weights / 2
    missed = (1 - points) * share[:, :, None]
    part = missed, missed + points
    before, behind = [np.ones((n, 1, len(points)))], [np.ones((n, 1, len(points)))]
    for k in range(d - 1):
        before.append(np.concatenate([before[-1] * p[:, None, k] for p in part], axis=1))
        behind.append(np.stack([behind[-1] * p[:, None, d - 1 - k] for p in part], axis=2).reshape(n, -1, len(points)))
    out = np.empty((d, n, 2 ** d))
    for j in range(d):
        others = (behind[d - 1 - j] * weights) @ before[j].transpose(0, 2, 1)
        cells = out[j].reshape(n, others.shape[1], 2, others.shape[2])
        for met in (0, 1):
            cells[:, :, met] = others * ((met - share[:, j]) * value)[:, None, None]
    return out


def _other_side(a: tuple, b: tuple) -> int | None:
    """Position of the one path feature in which leaf ``b`` takes just the rows that ``a`` misses, if all else on their paths is equal."""
    if a[0] != b[0]:
        return None
    apart = [j for j, (p, q) in enumerate(zip(zip(*a[1:]), zip(*b[1:]))) if p != q]
    if len(apart) != 1:
        return None
    (low, high), (low2, high2) = ((s[1][apart[0]], s[2][apart[0]]) for s in (a, b))
    return apart[0] if np.isposinf(high) and np.isneginf(low2) and low == high2 else None


def shapley_of_many(x: np.ndarray, table: list[Leaves], width: int) -> np.ndarray:
    """``shapley_values`` of many rows: a row's values at a leaf depend only on which of its d path features it meets, so
    all 2^d patterns are worked out once and looked up.  Two leaves of one last cut have each other's patterns with that bit
    turned, so they share one look-up.  Leaves with as many patterns as rows take the plain form."""
    x, plain = np.asarray(x, dtype=float), []
    columns, out = np.ascontiguousarray(x.T), np.zeros((width, len(x)))
    for leaves in table:
        d = leaves.feature.shape[1]
        if 2 ** d > len(x) // 2:
            plain.append(leaves)
            continue
        for start in range(0, len(leaves.value), LEAVES_AT_ONCE):
            some = slice(start, start + LEAVES_AT_ONCE)
            gains = _pattern_tables(leaves.share[some], leaves.value[some])
            met: dict[tuple, np.ndarray] = {}  # neighbouring leaves share most of their path
            paths = list(zip(leaves.feature[some].tolist(), leaves.low[some].tolist(), leaves.high[some].tolist()))
            added, bits, found = False, np.uint16 if d <= 16 else np.uint32, np.empty(len(x))
            for i, (names, lows, highs) in enumerate(paths):
                if added:  # to the leaf before
                    added = False
                    continue
                turned = _other_side(paths[i], paths[i + 1]) if i + 1 < len(paths) else None
                if turned is not None:
                    gains[:, i] += gains[:, i + 1].reshape(d, -1, 2, 1 << turned)[:, :, ::-1].reshape(d, -1)
                    added = True
                pattern = np.zeros(len(x), dtype=bits)
                for j, cell in enumerate(zip(names, lows, highs)):
                    if cell not in met:
                        f, low, high = cell
                        o = ~(columns[f] <= low)
                        met[cell] = (o if np.isinf(high) else o & (columns[f] <= high)).astype(bits)
                    pattern |= met[cell] << bits(j)
                at = pattern.astype(np.intp)
                for j, f in enumerate(names):
                    np.take(gains[j, i], at, out=found, mode="clip")
                    out[f] += found
    return out.T + shapley_by_parts(x, plain, width) if plain else out.T


def shapley_by_parts(x: np.ndarray, table: list[Leaves], width: int) -> np.ndarray:
    """``shapley_values`` with the rows taken in small parts, which bounds the memory."""
    return np.concatenate([shapley_values(x[i:i + ROWS_AT_ONCE], table, width) for i in range(0, len(x), ROWS_AT_ONCE)])


def tree_attribution(model, matrix: DataFrame, features: list[str], key: str = "listing_id", sample: int | None = None,
                     extra: list[str] = [], rows: DataFrame | None = None) -> DataFrame:
    """Exact Shapley values of a tree ensemble, one row per key and feature, from the trees' own node table.

    A row's values add up to its prediction minus the ensemble's mean over the fitted rows (``expected_value``).  Rows are
    explained where they lie, without a shuffle; explained are all rows of ``matrix``, or ``rows``, or a ``sample`` if asked for.
    """
    table, _ = leaf_table(*tree_nodes(model, matrix.sparkSession))
    src = _chosen(matrix, rows, key, sample).select(key, *extra, F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("_x"))
    width = len(features)

    def run(batches):
        held, n = [], 0

        def explained():
            b = pd.concat(held, ignore_index=True)
            x = np.array([[np.nan if v is None else v for v in r] for r in b["_x"]], dtype=float)
            values = shapley_of_many(x, table, width)
            for start in range(0, len(b), ROWS_AT_ONCE):
                part = slice(start, start + ROWS_AT_ONCE)
                yield b.iloc[part].drop(columns="_x").assign(_a=list(values[part]))
        for b in batches:
            for start in range(0, len(b), ROWS_HELD):
                held.append(b.iloc[start:start + ROWS_HELD])
                n += len(held[-1])
                if n >= ROWS_HELD:
                    yield from explained()
                    held, n = [], 0
        if n:
            yield from explained()
    kept = src.drop("_x").schema
    values = src.mapInPandas(run, StructType([*kept.fields, StructField("_a", ArrayType(DoubleType()))]))
    names = F.array(*[F.lit(f) for f in features])
    return values.select(key, *extra, F.inline(F.arrays_zip(names.alias("feature"), F.col("_a").alias("attribution")))).toDF(
        key, *extra, "feature", "attribution")


def expected_value(model, spark: SparkSession) -> float:
    """Mean of a tree ensemble over the rows it was fitted on."""
    return leaf_table(*tree_nodes(model, spark))[1]


def attribution(model, matrix: DataFrame, features: list[str], **options) -> DataFrame:
    return linear_attribution(model, matrix, features, **options) if hasattr(model, "coefficients") else \
        tree_attribution(model, matrix, features, **options)


def importance(values: DataFrame, by: list[str] = [], top: int = 20, min_rows: int = 10, key: str = "listing_id") -> DataFrame:
    """Mean size of the attribution per feature, ranked; groups with few explained rows are left out.

    A group whose keys fall into ``min_rows`` of 64 hash buckets has that many keys; keys are compared only in the other groups.
    """
    mean, groups = F.avg(F.abs("attribution")).alias("mean_abs"), [*by, "feature"]
    if by:
        buckets = F.bit_or(F.expr(f"CASE WHEN `{key}` IS NOT NULL THEN shiftleft(1L, CAST(pmod(xxhash64(`{key}`), 64) AS INT)) ELSE 0L END"))
        per = checkpointed(values.groupBy(*groups).agg(mean, buckets.alias("_in")))
        enough = F.bit_count("_in") >= min_rows
        few = per.filter(~enough).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)])
        if not few.isEmpty():
            same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(groups)]
            counted = (values.join(small_side(few), same, "left_semi").groupBy(*groups).agg(F.count_distinct(key).alias("_n"))
                       .select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], "_n"))
            per = per.join(small_side(counted), same, "left")
            enough = enough | (F.col("_n") >= min_rows)
        per = per.filter(enough).select(*groups, "mean_abs")
    else:
        per = values.groupBy("feature").agg(mean)
    w = Window.partitionBy(*by).orderBy(F.desc("mean_abs"), "feature")  # one row per group and feature
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def local_cases(predictions: DataFrame, key: str = "listing_id") -> DataFrame:
    """Cheapest, dearest, best, worst and middle prediction."""
    e = F.abs(F.col("y") - F.col("yhat"))
    ends = predictions.agg(F.min_by(key, F.struct("yhat", key)).alias("cheapest"), F.max_by(key, F.struct("yhat", key)).alias("dearest"),
                           F.min_by(key, F.struct(e, key)).alias("best"), F.max_by(key, F.struct(e, key)).alias("worst"))
    long = ends.select(F.inline(F.array(*[F.struct(F.lit(c).alias("case"), F.col(c).alias(key)) for c in ends.columns])))
    mid = exact_quantiles(predictions, [], {"m": (key, 0.5)}).select(F.floor("m").alias("_m"))
    middle = predictions.filter(F.col(key) >= mid.scalar()).agg(F.lit("middle").alias("case"), F.min(key).alias(key))
    return long.unionByName(middle)


def explain_cases(model, matrix: DataFrame, features: list[str], predictions: DataFrame, key: str = "listing_id", top: int = 5,
                  **options) -> DataFrame:
    """The features that raise and lower the selected predictions most; the cases are chosen among all predictions first,
    and exactly their rows are explained."""
    cases = checkpointed(local_cases(predictions, key).join(predictions.select(key, "y", "yhat"), key))  # five rows
    rows = matrix.join(F.broadcast(cases.select(key).distinct()), key, "left_semi")
    return local_explanations(attribution(model, matrix, features, key=key, rows=rows, **options), cases, key, top)


def local_explanations(values: DataFrame, cases: DataFrame, key: str = "listing_id", top: int = 5) -> DataFrame:
    mine = values.join(F.broadcast(cases), key)  # five cases
    up = Window.partitionBy("case").orderBy(F.desc("attribution"), "feature")
    down = Window.partitionBy("case").orderBy("attribution", "feature")
    placed = mine.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down))
    kept = placed.filter(((F.col("_up") <= top) & (F.col("attribution") > 0)) | ((F.col("_down") <= top) & (F.col("attribution") < 0)))
    return kept.select("case", key, F.expm1("y").alias("true_value"), from_target("yhat").alias("predicted_value"), "feature", "attribution")


def explain(model, matrix: DataFrame, features: list[str], predictions: DataFrame, path: str, key: str = "listing_id", city: str = "meta_city",
            top: int = 20, min_rows: int = 10) -> dict[str, DataFrame]:
    """The whole explanation job: values of all rows stored as Parquet below ``path`` and read back by its three reports:
    importance overall, importance per city, and the five chosen cases."""
    extra = [city] if city in matrix.columns else []
    attribution(model, matrix, features, key=key, extra=extra).write.mode("overwrite").parquet(f"{path}/values")
    values = matrix.sparkSession.read.parquet(f"{path}/values")
    cases = checkpointed(local_cases(predictions, key).join(predictions.select(key, "y", "yhat"), key))  # five rows
    out = {"values": values, "importance": importance(values, top=top, key=key), "cases": local_explanations(values.drop(*extra), cases, key)}
    if extra:
        out["importance_by_city"] = importance(values, [city], top, min_rows, key)
    for name in out.keys() - {"values"}:
        out[name].write.mode("overwrite").json(f"{path}/{name}")
    return out
