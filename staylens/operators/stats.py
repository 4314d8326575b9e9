"""Statistical tests, effect sizes, intervals and regression from distributed sufficient statistics.

Data are reduced on the cluster (moments, value counts, cross-products); what is left is one row per test or a
small matrix, on which tail probabilities and solves are computed.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import tails
from ..functions.rounding import as_col, ratio, rows
from .distribution import rows_union
from .joins import small_side
from .ordering import checkpointed, join_groups, medians, running_totals, tie_ranks
from .ranks import rank_correlations

# fixed values: effect size cuts (small, medium, large)
COHEN, BISERIAL, VARIANCE_SHARE = (0.2, 0.5, 0.8), (0.1, 0.3, 0.5), (0.01, 0.06, 0.14)
POSTHOC_GROUPS = 20
ALPHA = 0.05


def magnitude(effect, cuts: tuple[float, float, float]) -> Column:
    size = F.abs(as_col(effect))
    return (F.when(size >= cuts[2], "large").when(size >= cuts[1], "medium").when(size >= cuts[0], "small")
            .otherwise("negligible"))


def moments(df: DataFrame, group: list[str], value: str | Column) -> DataFrame:
    """n, mean and sample variance per group over known values."""
    src = df.select(*group, as_col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    return src.groupBy(*group).agg(rows().alias("n"), F.avg("_x").alias("mean"), F.var_samp("_x").alias("var"))


# ---- normality and variance ------------------------------------------------------------------------
def normality(df: DataFrame, group: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """D'Agostino-Pearson K² per group; fewer than 8 values give no verdict."""
    m = df.filter(F.col(value).isNotNull()).groupBy(*group).agg(
        rows().cast("double").alias("n"), F.skewness(F.col(value).cast("double")).alias("g1"),
        F.kurtosis(F.col(value).cast("double")).alias("g2"))
    n, enough = F.col("n"), F.col("n") >= 8
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    u = y / F.sqrt(2 / (w2 - 1))
    zs = F.log(u + F.sqrt(u * u + 1)) / F.sqrt(F.log(w2) / 2)
    expected = 3 * (n - 1) / (n + 1)
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("g2") + 3 - expected) / F.sqrt(spread)
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + F.sqrt(1 + 4 / (sb * sb)))
    denom = 1 + x * F.sqrt(2 / (a - 4))
    root = F.signum(denom) * F.pow((1 - 2 / a) / F.abs(denom), F.lit(1 / 3))
    zk = (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))
    big = m.filter(enough).withColumn("statistic", zs * zs + zk * zk).withColumn("p_value", F.exp(-F.col("statistic") / 2))
    small = m.filter(~enough).withColumn("statistic", F.lit(None).cast("double")).withColumn("p_value", F.lit(None).cast("double"))
    return big.unionByName(small).select(
        *group, F.when(enough, "D'Agostino-Pearson").otherwise("Insufficient data").alias("test"),
        n.cast("long").alias("n"), "statistic", "p_value", F.coalesce(F.col("p_value") > alpha, F.lit(False)).alias("is_normal"))


def _f_ratio(m: DataFrame) -> DataFrame:
    """One-way F from per-group n, mean and variance."""
    whole = m.agg(F.sum("n").alias("n_total"), rows().alias("k"),
                  ratio(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("grand"),
                  F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ss_within"))
    grand = whole.select("grand").scalar()
    between = m.agg(F.sum(F.col("n") * (F.col("mean") - grand) * (F.col("mean") - grand)).alias("ss_between"))
    both = join_groups(whole, between, [])
    return both.select("k", F.col("n_total").cast("long").alias("n_total"), (F.col("k") - 1).alias("df_between"),
                       (F.col("n_total") - F.col("k")).cast("long").alias("df_within"),
                       ratio(F.col("ss_between") / (F.col("k") - 1), F.col("ss_within") / (F.col("n_total") - F.col("k"))).alias("statistic"))


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """Equality of variances: F of absolute deviations from the group medians."""
    med = medians(df, [group], {"_med": value})
    dev = df.select(group, value).join(small_side(med), group).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    return _f_ratio(moments(dev, [group], "_dev"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance with eta squared."""
    out = _f_ratio(moments(df, [group], value))
    eta = eta_squared("statistic", "df_between", "df_within")
    return out.withColumn("effect", eta).withColumn("magnitude", magnitude("effect", VARIANCE_SHARE))


def with_f_tail(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", tails.f_tail(F.col("statistic"), F.col("df_between").cast("double"), F.col("df_within").cast("double")))


# ---- effect sizes -------------------------------------------------------------------------------------
def cohens_d_from(n1, m1, v1, n2, m2, v2) -> Column:
    """Standardised mean difference; 0 with fewer than two values or no spread."""
    n1, m1, v1, n2, m2, v2 = (as_col(c) for c in (n1, m1, v1, n2, m2, v2))
    pooled = F.sqrt(ratio((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    return F.when((n1 < 2) | (n2 < 2) | (pooled == 0), F.lit(0.0)).otherwise((m1 - m2) / pooled)


def eta_squared(f, between, within) -> Column:
    top = as_col(f) * as_col(between)
    return F.coalesce(ratio(top, top + as_col(within)), F.lit(0.0))


def epsilon_squared(h, n, k) -> Column:
    h, n, k = as_col(h), as_col(n), as_col(k)
    return F.when(n > k, F.greatest(F.lit(0.0), (h - k + 1) / (n - k))).otherwise(F.lit(0.0))


def rank_biserial(u, n1, n2) -> Column:
    return F.coalesce(F.lit(1.0) - ratio(as_col(u) * 2, as_col(n1).cast("double") * as_col(n2)), F.lit(0.0))


def _two_moments(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Both groups' moments in one row."""
    x = F.col(value).cast("double")
    xa, xb = F.when(F.col(group) == a, x), F.when(F.col(group) == b, x)
    return df.filter(F.col(group).isin(a, b)).agg(
        F.count(xa).alias("n_a"), F.avg(xa).alias("mean_a"), F.var_samp(xa).alias("var_a"),
        F.count(xb).alias("n_b"), F.avg(xb).alias("mean_b"), F.var_samp(xb).alias("var_b"))


def cohens_d(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    d = cohens_d_from("n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b")
    return _two_moments(df, group, value, a, b).withColumn("d", d).withColumn("magnitude", magnitude("d", COHEN))


def pairwise_effects(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Cohen's d and medians for every pair of groups and every metric."""
    parts = []
    for metric in metrics:
        m = join_groups(moments(df, [group], metric), medians(df, [group], {"median": metric}), [group])
        parts.append(m.select(F.lit(metric).alias("metric"), F.col(group).alias("g"), "n", "mean", "var", "median"))
    table = rows_union(parts)  # one row per metric and group
    left = table.select("metric", *[F.col(c).alias(f"{c}_a") for c in ("g", "n", "mean", "var", "median")])
    right = table.select("metric", *[F.col(c).alias(f"{c}_b") for c in ("g", "n", "mean", "var", "median")])
    pairs = left.join(right, "metric").filter("g_a < g_b")
    d = cohens_d_from("n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b")
    return pairs.select("metric", F.col("g_a").alias("group_a"), F.col("g_b").alias("group_b"), d.alias("d"),
                        magnitude(d, COHEN).alias("magnitude"), "median_a", "median_b")


# ---- intervals ------------------------------------------------------------------------------------------
def mean_ci(df: DataFrame, group: list[str], value: str, level: float = 0.95) -> DataFrame:
    """t interval of the mean; groups with fewer than two values have no bounds."""
    m = moments(df, group, value)
    t = tails.t_critical(F.lit(1 - (1 - level) / 2), (F.col("n") - 1).cast("double"))
    half = t * F.sqrt(F.col("var") / F.col("n"))
    ok = F.col("n") >= 2
    return m.select(*group, "n", "mean", F.when(ok, F.col("mean") - half).alias("ci_lower"),
                    F.when(ok, F.col("mean") + half).alias("ci_upper"))


# fixed values: cumulative Poisson(1) probabilities for 0..8 events
POISSON_STEPS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def block_weights(resamples: int, blocks: int, seed: int) -> np.ndarray:
    """Poisson(1) weights, one row per resample and one column per block of rows; the same numbers in every worker.

    Four resamples share the md5 of ``block|number|seed``; eight hex digits of it are a number in [0, 1).
    """
    key = (resamples, blocks, seed)
    if key not in _WEIGHTS:
        quads = (resamples + 3) // 4
        raw = b"".join(hashlib.md5(f"{k}|{i}|{seed}".encode()).digest() for k in range(blocks) for i in range(quads))
        u = np.frombuffer(raw, ">u4").reshape(blocks, quads * 4)[:, :resamples] / 4294967296.0
        _WEIGHTS.clear()
        _WEIGHTS[key] = np.searchsorted(POISSON_STEPS, u, side="right").T.astype(np.float32)
    return _WEIGHTS[key]


_WEIGHTS: dict[tuple, np.ndarray] = {}
_AT_ONCE = 1000  # resamples of one matrix product


def _in_block(key: str, seed: int, blocks: int) -> Column:
    text = F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % blocks


def bootstrap(df: DataFrame, group: list[str], parts: dict[str, Column], statistic, key: str, resamples: int = 10_000, level: float = 0.95,
              seed: int = 42, blocks: int = 1_000) -> DataFrame:
    """(*group, estimate, ci_lower, ci_upper): percentile interval of any function of sums, by a Poisson bootstrap over random blocks of rows.

    ``parts`` names expressions that are summed (a missing value adds nothing); ``statistic`` takes a dict of numpy arrays,
    the sums of each resample, and returns an array: ``lambda t: t["revenue"] / t["nights"]``.  Rows fall into ``blocks``
    blocks per group by a hash of ``key`` and are summed there, so a group of any size is one short row of block sums;
    its resamples are one product with the matrix of weights.  Resamples without a value are left out of the percentiles.
    """
    cells = df.groupBy(*group, _in_block(key, seed, blocks).alias("_block")).agg(*[F.sum(c.cast("double")).alias(f"_p{i}") for i, c in enumerate(parts.values())])
    columns, names = [F.coalesce(f"_p{i}", F.lit(0.0)) for i in range(len(parts))], list(parts)
    return _resampled(cells, group, columns, lambda _: lambda totals: statistic(dict(zip(names, totals.T))), resamples, level, seed, blocks)


def bootstrap_quantile(df: DataFrame, group: list[str], value: str, key: str, q: float = 0.5, resamples: int = 10_000, level: float = 0.95,
                       seed: int = 42, blocks: int = 1_000, candidates: int = 400) -> DataFrame:
    """(*group, estimate, ci_lower, ci_upper): percentile interval of a quantile, the smallest value that a share ``q`` of the weights reaches.

    Values are counted by (block, value); a resample's quantile is read from weighted counts up to each candidate.  Groups
    with at most ``candidates`` distinct values use all of them, others values at even ranks within eight standard errors
    around the quantile, so the bounds are within 1/25 of a standard error of the rank.
    """
    src = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"), _in_block(key, seed, blocks).alias("_block"))
    counts = checkpointed(src.groupBy(*group, "_v", "_block").agg(rows().alias("_n")))
    up = running_totals(counts.groupBy(*group, "_v").agg(F.sum("_n").alias("_n")), group, ["_v"], {"_upto": "_n", "_place": F.lit(1).cast("long")})
    sizes = up.groupBy(*group).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_values"))
    ranked = _beside(up, sizes, group)
    middle, width = F.col("_all") * q, 8 * F.sqrt(F.col("_all") * (q * (1 - q))) + 1
    # the value that holds a wanted rank: the step between even ranks changes inside it
    step = 2 * width / candidates
    nth = lambda c: F.floor((F.least(F.greatest(c, middle - width), middle + width) - middle) / step)
    chosen = ranked.filter((F.col("_values") <= candidates) | (nth(F.col("_upto")) > nth(F.col("_upto") - F.col("_n")))
                           | ((F.col("_upto") >= middle) & (F.col("_upto") - F.col("_n") < middle)) | (F.col("_place") == F.col("_values"))).select(*group, "_v")
    at = F.array_sort(F.collect_set("_v"))
    steps = checkpointed(chosen.groupBy(*group).agg(at.alias("_at")))  # a short list per group
    cell = _beside(counts, steps, group)
    spot = F.size(F.filter("_at", lambda c: c < F.col("_v")))
    by_step = cell.groupBy(*group, "_block", "_at", spot.alias("_k")).agg(F.sum("_n").alias("_n"))
    cells = by_step.groupBy(*group, "_block").agg(F.max("_at").alias("_at"), F.map_from_entries(F.collect_list(F.struct("_k", F.col("_n").cast("double")))).alias("_m"))
    filled = F.transform(F.sequence(F.lit(0), F.size("_at") - 1), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0)))

    def read(at):
        def quantile(totals):
            reach = np.cumsum(totals, axis=1)
            found = np.argmax(reach >= q * reach[:, -1:], axis=1)
            return np.where(reach[:, -1] > 0, np.asarray(at)[found], np.nan)
        return quantile

    return _resampled(cells.withColumn("_f", filled), group, ["_f"], read, resamples, level, seed, blocks, at="_at")


def _beside(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row per group."""
    return join_groups(left, right, group) if group else left.withColumns({c: right.select(c).scalar() for c in right.columns})


def _resampled(cells: DataFrame, group: list[str], columns: list, statistic, resamples: int, level: float, seed: int, blocks: int, at: str | None = None) -> DataFrame:
    """One row per group from its block sums: the estimate with all weights 1, and the percentiles over resamples."""
    values = F.flatten(F.array(*[F.col(c) for c in columns])) if at else F.array(*columns)
    packed = cells.groupBy(*group).agg(F.collect_list(F.struct(F.col("_block").alias("b"), values.alias("v"))).alias("_cells"),
                                       *([F.max(at).alias("_at")] if at else []))
    tail = (1 - level) / 2
    inner, n_keys = [StructField(f"_g{i}", packed.schema[c].dataType) for i, c in enumerate(group)], len(group)
    names = [*[f.name for f in inner], "estimate", "ci_lower", "ci_upper"]
    kept = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]

    def run(batches):
        weights = block_weights(resamples, blocks, seed)
        for b in batches:
            out = []
            for i, cell in enumerate(b.column("_cells")):
                cell = cell.as_py()
                use = statistic(b.column("_at")[i].as_py() if at else None)
                where, sums = np.array([x["b"] for x in cell]), np.array([x["v"] for x in cell], float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    got = np.concatenate([use(weights[r:r + _AT_ONCE][:, where].astype(float) @ sums) for r in range(0, resamples, _AT_ONCE)])
                    point = float(use(sums.sum(axis=0, keepdims=True))[0])
                got = got[np.isfinite(got)]
                ends = np.quantile(got, [tail, 1 - tail]).tolist() if len(got) else [None, None]
                out.append((point if np.isfinite(point) else None, *ends))
            yield pa.RecordBatch.from_arrays([*[b.column(f"_g{i}") for i in range(n_keys)], *[pa.array(c, pa.float64()) for c in (zip(*out) if out else ([], [], []))]],
                                             names=names)

    kinds = StructType([*inner, *[StructField(c, DoubleType()) for c in ("estimate", "ci_lower", "ci_upper")]])
    done = packed.select(*kept, "_cells", *(["_at"] if at else [])).mapInArrow(run, kinds)
    return done.select(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(group)], "estimate", "ci_lower", "ci_upper")


def bootstrap_mean(df: DataFrame, group: list[str], value: str, key: str, resamples: int = 10_000,
                   level: float = 0.95, seed: int = 42, blocks: int = 1_000) -> DataFrame:
    """(*group, n, mean, ci_lower, ci_upper): ``bootstrap`` of the mean of the values that are there."""
    src = df.filter(F.col(value).isNotNull())
    bounds = bootstrap(src, group, {"n": F.lit(1), "s": F.col(value)}, lambda t: t["s"] / t["n"], key, resamples, level, seed, blocks)
    point = src.groupBy(*group).agg(rows().alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    return join_groups(point, bounds.drop("estimate"), group)


# ---- two groups -------------------------------------------------------------------------------------------
def welch(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Welch's t and its degrees of freedom."""
    m = _two_moments(df, group, value, a, b)
    qa, qb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    dof = (qa + qb) * (qa + qb) / (qa * qa / (F.col("n_a") - 1) + qb * qb / (F.col("n_b") - 1))
    return m.select("n_a", "n_b", ((F.col("mean_a") - F.col("mean_b")) / F.sqrt(qa + qb)).alias("statistic"), dof.alias("df"),
                    cohens_d_from("n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b").alias("effect"))


def _sided(p_upper: Column, p_lower: Column, alternative: str) -> Column:
    if alternative == "greater":
        return p_upper
    if alternative == "less":
        return p_lower
    return F.least(F.lit(1.0), F.least(p_upper, p_lower) * 2)


def rank_sum(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Mann-Whitney U of group ``a`` with the tie-corrected standard error."""
    src = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull())
    cells = src.groupBy(value).agg(F.count_if(F.col(group) == a).alias("_na"), F.count_if(F.col(group) == b).alias("_nb"))
    run = running_totals(cells, [], [value], {"_cum_b": "_nb"})
    return _u_row(run, [])


def _u_row(run: DataFrame, keys: list[str]) -> DataFrame:
    """U from counts per value: every ``a`` beats the ``b`` below it and half of the equal ones."""
    t = (F.col("_na") + F.col("_nb")).cast("double")
    wins = F.col("_na") * (F.col("_cum_b") - F.col("_nb") + F.col("_nb") / 2)
    s = run.groupBy(*keys).agg(F.sum("_na").alias("n_a"), F.sum("_nb").alias("n_b"), F.sum(wins).cast("double").alias("u"),
                               F.sum(t * t * t - t).alias("_ties"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    se = F.sqrt(na * nb / 12 * (n + 1 - ratio("_ties", n * (n - 1))))
    return s.select(*keys, "n_a", "n_b", F.col("u").alias("statistic"), (F.col("u") - na * nb / 2).alias("above_mean"),
                    se.alias("se"), rank_biserial("u", "n_a", "n_b").alias("effect"))


def rank_sum_p(df: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """Normal tail with continuity correction."""
    up = tails.normal_tail((F.col("above_mean") - 0.5) / F.col("se"))
    low = tails.normal_tail((-F.col("above_mean") - 0.5) / F.col("se"))
    return df.withColumn("p_value", _sided(up, low, alternative))


def two_group_test(df: DataFrame, group: str, value: str, a, b, name: str = "", alternative: str = "two-sided",
                   alpha: float = ALPHA) -> DataFrame:
    """Welch's t when both groups look normal, else Mann-Whitney U; one row with decision and effect."""
    both = df.filter(F.col(group).isin(a, b))
    normal = normality(both, [group], value, alpha).agg(F.bool_and("is_normal").alias("ok"), rows().alias("k")).first()
    if normal.ok and normal.k == 2:
        t = welch(both, group, value, a, b)
        up = tails.t_tail(F.col("statistic"), F.col("df"))
        out = t.withColumn("p_value", _sided(up, F.lit(1.0) - up, alternative))
        test, effect, cuts = "Welch's t-test", "Cohen's d", COHEN
    else:
        out = rank_sum_p(rank_sum(both, group, value, a, b), alternative)
        test, effect, cuts = "Mann-Whitney U", "rank-biserial r", BISERIAL
    return _result_row(out, name, test, effect, cuts, alpha)


RESULT = ["hypothesis", "test", "statistic", "p_value", "effect", "effect_label", "magnitude", "is_significant", "n_total"]


def _result_row(out: DataFrame, name: str, test: str, effect: str, cuts: tuple, alpha: float) -> DataFrame:
    n = F.col("n_total") if "n_total" in out.columns else F.col("n_a") + F.col("n_b") if "n_b" in out.columns else F.col("n")
    return out.select(F.lit(name).alias("hypothesis"), F.lit(test).alias("test"), "statistic", "p_value", "effect",
                      F.lit(effect).alias("effect_label"), magnitude("effect", cuts).alias("magnitude"),
                      (F.col("p_value") < alpha).alias("is_significant"), n.cast("long").alias("n_total"))


# ---- several groups -----------------------------------------------------------------------------------------
def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction and epsilon squared."""
    src = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    cells = src.groupBy(group, value).agg(rows().alias("_c"))
    ranks = tie_ranks(src, [], value)
    placed = cells.join(ranks.select(value, "rank"), value)
    per = placed.groupBy(group).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col("rank")).alias("r"))
    t = F.col("n").cast("double")
    ties = ranks.agg(F.sum(t * t * t - t))
    s = per.agg(F.sum("n").cast("double").alias("n_total"), rows().alias("k"),
                F.sum(F.col("r") * F.col("r") / F.col("n")).alias("ss"))
    n = F.col("n_total")
    h = (F.lit(12.0) / (n * (n + 1)) * F.col("ss") - 3 * (n + 1)) / (1 - ratio(ties.scalar(), n * n * n - n))
    out = s.select("k", n.cast("long").alias("n_total"), h.alias("statistic"))
    return out.withColumn("effect", epsilon_squared("statistic", "n_total", "k")).withColumn(
        "magnitude", magnitude("effect", VARIANCE_SHARE))


def with_chi2_tail(df: DataFrame, dof: Column) -> DataFrame:
    return df.withColumn("p_value", tails.chi2_tail(F.col("statistic"), dof.cast("double")))


def pairwise_rank_sums(df: DataFrame, group: str, value: str, max_groups: int = POSTHOC_GROUPS) -> DataFrame:
    """Mann-Whitney U for every pair of at most ``max_groups`` groups, all pairs in one plan.

    Rows are first reduced to counts per (group, value); only these counts are repeated per pair.
    """
    src = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    names = sorted(r[0] for r in src.select(group).distinct().limit(max_groups + 1).collect())
    if len(names) > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    cells = src.groupBy(F.col(group).alias("_g"), value).agg(rows().alias("_c"))
    others = cells.withColumn("_o", F.explode(F.array(*[F.lit(x) for x in names]))).filter("_o <> _g")
    first = F.least("_g", "_o")
    per = others.groupBy(first.alias("group_a"), F.greatest("_g", "_o").alias("group_b"), value).agg(
        F.coalesce(F.sum(F.when(F.col("_g") == first, F.col("_c"))), F.lit(0)).alias("_na"),
        F.coalesce(F.sum(F.when(F.col("_g") != first, F.col("_c"))), F.lit(0)).alias("_nb"))
    run = running_totals(per, ["group_a", "group_b"], [value], {"_cum_b": "_nb"})
    return _u_row(run, ["group_a", "group_b"]).withColumn("magnitude", magnitude("effect", BISERIAL))


def posthoc(df: DataFrame, group: str, value: str, alpha: float = ALPHA, max_groups: int = POSTHOC_GROUPS) -> DataFrame:
    """Pairwise tests with Bonferroni-corrected p-values."""
    out = rank_sum_p(pairwise_rank_sums(df, group, value, max_groups))
    k = df.filter(F.col(value).isNotNull()).agg(F.count_distinct(group)).scalar()
    adjusted = F.least(F.lit(1.0), F.col("p_value") * k * (k - 1) / 2)
    return out.withColumn("p_adjusted", adjusted).withColumn("is_significant", F.col("p_adjusted") < alpha)


def multi_group_test(df: DataFrame, group: str, value: str, name: str = "", alpha: float = ALPHA,
                     with_posthoc: bool = True) -> dict[str, DataFrame]:
    """ANOVA when every group looks normal, else Kruskal-Wallis; post-hoc pairs when significant.

    With more than ``POSTHOC_GROUPS`` groups the pairs are left out and ``skipped`` says so in one row.
    """
    known = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    big = known.groupBy(group).agg(rows().alias("_n")).filter("_n >= 2").drop("_n")
    src = known.join(big, group, "left_semi")
    k = big.count()
    normal = normality(src, [group], value, alpha).agg(F.bool_and("is_normal")).first()[0]
    if normal:
        out = with_f_tail(anova(src, group, value))
        row = _result_row(out, name, "One-way ANOVA", "η² (eta-squared)", VARIANCE_SHARE, alpha)
    else:
        out = with_chi2_tail(kruskal_wallis(src, group, value), F.col("k") - 1)
        row = _result_row(out, name, "Kruskal-Wallis H", "ε² (epsilon-squared)", VARIANCE_SHARE, alpha)
    if not with_posthoc:
        return {"test": row}
    if k > POSTHOC_GROUPS:
        note = df.sparkSession.createDataFrame([(name, k, POSTHOC_GROUPS)], "hypothesis string, n_groups long, posthoc_limit long")
        return {"test": row, "skipped": note}
    row = checkpointed(row)
    result = {"test": row}
    if row.first().is_significant:
        result["posthoc"] = posthoc(src, group, value, alpha)
    return result


# ---- pairs ------------------------------------------------------------------------------------------------
def signed_rank(df: DataFrame, a: str, b: str) -> DataFrame:
    """Wilcoxon signed-rank sums of the non-zero differences."""
    diff = df.select((F.col(a) - F.col(b)).cast("double").alias("_d")).filter("_d IS NOT NULL AND _d <> 0")
    cells = diff.groupBy(F.abs("_d").alias("_m")).agg(F.count_if(F.col("_d") > 0).alias("_up"), rows().alias("_c"))
    run = running_totals(cells, [], ["_m"], {"_upto": "_c"})
    rank = F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / F.lit(2.0)
    t = F.col("_c").cast("double")
    s = run.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("double").alias("n"), F.sum(rank * F.col("_up")).alias("plus"),
                F.sum(rank * (F.col("_c") - F.col("_up"))).alias("minus"), F.sum(t * t * t - t).alias("_ties"))
    n = F.col("n")
    se = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    return s.select(n.cast("long").alias("n"), "plus", "minus", F.least("plus", "minus").alias("statistic"),
                    ratio(F.col("plus") - n * (n + 1) / 4, se).alias("z"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    m = moments(df, [], F.col(a) - F.col(b))
    return m.select("n", F.col("mean").alias("mean_difference"), (F.col("mean") / F.sqrt(F.col("var") / F.col("n"))).alias("statistic"),
                    (F.col("n") - 1).alias("df"))


def paired_test(df: DataFrame, a: str, b: str, name: str = "", alternative: str = "two-sided", alpha: float = ALPHA) -> DataFrame:
    """Paired t when the differences look normal, else Wilcoxon; fewer than 10 differences give p = 1."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    effect = pairs.agg(cohens_d_from(F.count(x), F.avg(x), F.var_samp(x), F.count(y), F.avg(y), F.var_samp(y)).alias("effect"),
                       F.avg(x - y).alias("mean_difference"))
    normal = normality(pairs.select((x - y).alias("_d")), [], "_d", alpha).first()
    if normal is not None and normal.is_normal:
        t = paired_t(pairs, a, b).drop("mean_difference")
        up = tails.t_tail(F.col("statistic"), F.col("df").cast("double"))
        out, test = t.withColumn("p_value", _sided(up, F.lit(1.0) - up, alternative)), F.lit("Paired t-test")
    else:
        w = signed_rank(pairs, a, b)
        up = tails.normal_tail(F.col("z"))
        few = F.col("n") < 10
        out = w.withColumn("p_value", F.when(few, F.lit(1.0)).otherwise(_sided(up, F.lit(1.0) - up, alternative)))
        test = F.when(few, "Wilcoxon (insufficient non-zero diffs)").otherwise("Wilcoxon signed-rank")
    row = join_groups(out.withColumn("_test", test), effect, [])
    return row.select(F.lit(name).alias("hypothesis"), F.col("_test").alias("test"), F.coalesce("statistic", F.lit(0.0)).alias("statistic"),
                      "p_value", "effect", F.lit("Cohen's d (paired)").alias("effect_label"), magnitude("effect", COHEN).alias("magnitude"),
                      (F.col("p_value") < alpha).alias("is_significant"), F.col("n").cast("long").alias("n_total"), "mean_difference")


# ---- counts and correlation ---------------------------------------------------------------------------------
def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categories from their joint counts (continuity correction for 2 x 2)."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(rows().alias("_o"))
    ra = cells.groupBy("_a").agg(F.sum("_o").alias("_ra"))
    cb = cells.groupBy("_b").agg(F.sum("_o").alias("_cb"))
    size = cells.agg(F.sum("_o").alias("n"), F.count_distinct("_a").alias("r"), F.count_distinct("_b").alias("c"))
    n = size.select("n").scalar()
    # absent combinations have observed 0 and expected ra * cb / n, which together is n minus the expected of present ones
    e = F.col("_ra").cast("double") * F.col("_cb") / n
    two = size.select((F.col("r") == 2) & (F.col("c") == 2)).scalar()
    gap = F.abs(F.col("_o") - e)
    gap = gap - F.when(two, F.least(F.lit(0.5), gap)).otherwise(F.lit(0.0))
    s = cells.join(ra, "_a").join(cb, "_b").agg(F.sum(gap * gap / e).alias("present"), F.sum(e).alias("covered"))
    both = join_groups(size, s, [])
    return both.select("n", ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"),
                       (F.col("present") + F.col("n") - F.col("covered")).alias("statistic"))


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of every pair of columns over the rows where both are known."""
    return rank_correlations(df, [(x, y) for i, x in enumerate(columns) for y in columns[i + 1:]])


def correlates(df: DataFrame, target: str, columns: list[str], top: int | None = None) -> DataFrame:
    """Columns ordered by the size of their rank correlation with ``target``."""
    m = rank_correlations(df, [(target, c) for c in columns if c != target])
    out = m.select(F.col("column_b").alias("feature"), "rho", F.abs("rho").alias("abs_rho"),
                   F.when(F.col("rho") > 0, "positive").otherwise("negative").alias("direction")).orderBy(F.desc("abs_rho"), "feature")
    return out.limit(top) if top else out


# ---- regression -----------------------------------------------------------------------------------------------
def _cross_products(df: DataFrame, columns: list[str], centre: bool = True):
    """Row count, means and cross-product matrix of a few columns in two passes."""
    n, *means = df.agg(rows(), *[F.avg(c) for c in columns]).first()
    if not n:
        return 0, np.zeros(len(columns)), np.zeros((len(columns), len(columns)))
    mu = np.array([float(m) for m in means]) if centre else np.zeros(len(columns))
    dev = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, mu)]
    cells = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = df.agg(*[F.sum(dev[i] * dev[j]) for i, j in cells]).first()
    s = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(cells, sums):
        s[i, j] = s[j, i] = float(v)
    return n, mu, s


def vif(df: DataFrame, features: list[str]) -> DataFrame:
    """Variance inflation per feature (regression without intercept), from one cross-product matrix."""
    spark = df.sparkSession
    src = df.select(*[F.col(c).cast("double").alias(c) for c in features]).dropna()
    _, _, s = _cross_products(src, features, centre=False)
    scale = np.sqrt(np.diag(s))
    scale[scale == 0] = 1.0
    corr = s / np.outer(scale, scale)
    try:
        values = np.diag(np.linalg.inv(corr))
    except np.linalg.LinAlgError:
        values = np.full(len(features), np.inf)
    rows_ = [(f, float(v), "SEVERE" if v > 10 else "MODERATE" if v > 5 else "") for f, v in zip(features, values)]
    return spark.createDataFrame(rows_, "feature string, vif double, flag string").orderBy(F.desc("vif"))


def ols(df: DataFrame, features: list[str], target: str, log_target: bool = True, alpha: float = ALPHA) -> dict[str, DataFrame]:
    """Least squares with intercept: coefficients, fit, residual normality and heteroscedasticity.

    Complete rows only; columns without variance are dropped.  Features are centred before their products are
    summed, and only the p x p matrix reaches the driver.
    """
    spark = df.sparkSession
    y = F.log1p(F.col(target).cast("double")) if log_target else F.col(target).cast("double")
    src = df.select(*[F.col(c).cast("double").alias(c) for c in features], y.alias("_y")).dropna()
    n, mu, s = _cross_products(src, [*features, "_y"])
    keep = [i for i in range(len(features)) if s[i, i] > 1e-12 * max(1.0, mu[i] ** 2) * max(n, 1)]
    names, dropped = [features[i] for i in keep], [features[i] for i in range(len(features)) if i not in keep]
    p = len(names)
    sxx, sxy, syy = s[np.ix_(keep, keep)], s[keep, -1], s[-1, -1]
    inv = np.linalg.pinv(sxx)
    b = inv @ sxy
    xbar = mu[keep]
    intercept = mu[-1] - xbar @ b
    dof = n - p - 1
    rss = max(float(syy - b @ sxy), 0.0)
    r2 = 1 - rss / syy if syy else float("nan")
    s2 = rss / dof
    se = np.sqrt(np.concatenate([[s2 * (1 / n + xbar @ inv @ xbar)], s2 * np.diag(inv)]))
    coef = np.concatenate([[intercept], b])
    t_crit = tails.t_quantile(1 - alpha / 2, dof)
    table = []
    for name, c, e in zip(["const", *names], coef, se):
        t = c / e if e else float("inf")
        table.append((name, float(c), float(e), float(t), float(2 * tails.t_sf(abs(t), dof)), float(c - t_crit * e), float(c + t_crit * e)))
    coefs = spark.createDataFrame(table, "feature string, coefficient double, std_error double, t_statistic double, "
                                         "p_value double, ci_lower double, ci_upper double")
    fitted = sum((F.col(c) * F.lit(float(v)) for c, v in zip(names, b)), F.lit(float(intercept)))
    resid = src.withColumn("_e", F.col("_y") - fitted).withColumn("_e2", F.col("_e") * F.col("_e"))
    jb = resid.agg((rows() / 6.0 * (F.pow(F.skewness("_e"), 2) + F.pow(F.kurtosis("_e"), 2) / 4)).alias("jb")).first()[0]
    _, _, q = _cross_products(resid, [*names, "_e2"])
    explained = q[:-1, -1] @ np.linalg.pinv(q[:-1, :-1]) @ q[:-1, -1]
    lm = n * explained / q[-1, -1] if q[-1, -1] else float("nan")
    f = (r2 / p) / ((1 - r2) / dof) if p and r2 < 1 else float("inf")
    fit = spark.createDataFrame([(float(r2), float(1 - (1 - r2) * (n - 1) / dof), float(f), float(tails.f_sf(f, p, dof)), int(n),
                                  float(jb), float(math.exp(-jb / 2)), float(lm), float(tails.chi2_sf(lm, p)), ",".join(dropped))],
                                "r_squared double, adj_r_squared double, f_statistic double, f_p_value double, n_observations long, "
                                "jarque_bera double, residual_normality_p double, breusch_pagan double, heteroscedasticity_p double, "
                                "dropped_columns string")
    return {"coefficients": coefs, "fit": fit}


def percent_effects(coefficients: DataFrame, top: int = 20, alpha: float = ALPHA) -> DataFrame:
    """Significant coefficients of a log model as percent changes, largest first."""
    return (coefficients.filter((F.col("p_value") < alpha))
            .select("feature", "coefficient", ((F.exp("coefficient") - 1) * 100).alias("pct_effect"), "t_statistic", "p_value")
            .orderBy(F.desc(F.abs("coefficient")), "feature").limit(top))


# ---- several tests ---------------------------------------------------------------------------------------------
def adjust_p(tests: DataFrame, p: str = "p_value", method: str = "holm", alpha: float = ALPHA, tie: str = "test") -> DataFrame:
    """Bonferroni, Holm or Benjamini-Hochberg over a table with one row per test."""
    up = Window.orderBy(p, tie)  # one row per test: a small table by construction
    m = rows().over(Window.partitionBy())
    place = F.row_number().over(up)
    if method == "bonferroni":
        raw = tests.withColumn("_adj", F.col(p) * m)
    elif method == "holm":
        raw = tests.withColumn("_s", F.col(p) * (m - place + 1)).withColumn(
            "_adj", F.max("_s").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")
    elif method == "fdr_bh":
        raw = tests.withColumn("_s", F.col(p) * m / place).withColumn(
            "_adj", F.min("_s").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))).drop("_s")
    else:
        raise ValueError(f"unknown method {method!r}")
    return raw.withColumn("p_adjusted", F.least(F.col("_adj"), F.lit(1.0))).withColumn(
        "is_significant", F.col("p_adjusted") < alpha).drop("_adj")
