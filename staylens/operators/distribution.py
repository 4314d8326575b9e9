"""Distribution summaries: moments, histograms, inequality, concentration, crosstabs, trends."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import as_col, ratio, rows
from .joins import small_side
from .ordering import ALL, exact_quantiles, join_groups, positions, running_totals

FIVE = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}


def unpivot(df: DataFrame, keep: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keep, columns, name, value)


def describe(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """n, mean, median, spread, quartiles and bias-adjusted skewness and kurtosis per group and variable."""
    long = unpivot(df, group, columns).filter("value IS NOT NULL")
    keys = [*group, "variable"]
    n, g1, g2 = rows().cast("double"), F.skewness("value"), F.kurtosis("value")
    stats = long.groupBy(*keys).agg(
        rows().alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"))
    qs = exact_quantiles(long, keys, {"q1": ("value", .25), "median": ("value", .5), "q3": ("value", .75)})
    return join_groups(stats, qs, keys).withColumn("iqr", F.col("q3") - F.col("q1"))


def five_numbers(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows of a box plot: minimum, quartiles, maximum and count."""
    long = unpivot(df, group, columns).filter("value IS NOT NULL")
    return exact_quantiles(long, [*group, "variable"], {k: ("value", p) for k, p in FIVE.items()},
                           with_count=True).drop(*[f"n_{k}" for k in FIVE if k != "low"]).withColumnRenamed("n_low", "n")


def histogram(df: DataFrame, column: str, bins: int, group: list[str] = [], upper: float | None = None) -> DataFrame:
    """Equal-width bins between the smallest and largest value of each group; the last bin is closed."""
    value = as_col(column).cast("double")
    src = df.filter(F.col(column).isNotNull()).select(
        *group, (F.least(value, F.lit(float(upper))) if upper is not None else value).alias("_v"))
    counts = src.groupBy(*group, "_v").agg(rows().alias("_n"))
    edges = counts.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    j = join_groups(counts, small_side(edges), group) if group else _with_single(counts, edges)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") > F.col("_lo"),
               F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    out = j.groupBy(*group, b.alias("bin"), "_lo", "_hi").agg(F.sum("_n").alias("n"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    return out.select(*group, "bin", (F.col("_lo") + step * F.col("bin")).alias("lower"),
                      (F.col("_lo") + step * (F.col("bin") + 1)).alias("upper"), "n")


def _with_single(df: DataFrame, one: DataFrame) -> DataFrame:
    return df.withColumns({c: one.select(c).scalar() for c in one.columns})


def log_histogram(df: DataFrame, column: str, bins: int, group: list[str] = []) -> DataFrame:
    """Bins of equal width on the log10 scale for positive values."""
    return histogram(df.filter(F.col(column) > 0).withColumn("_log", F.log10(column)), "_log", bins, group)


def density_grid(df: DataFrame, x: Column | str, y: Column | str, x_step: float, y_step: float,
                 group: list[str] = []) -> DataFrame:
    """Counts on a grid of fixed cell size (the data of a two-dimensional density plot)."""
    gx, gy = F.floor(as_col(x) / x_step), F.floor(as_col(y) / y_step)
    return df.filter(as_col(x).isNotNull() & as_col(y).isNotNull()).groupBy(
        *group, gx.alias("x_cell"), gy.alias("y_cell")).agg(rows().alias("n"))


def lorenz(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Cumulative shares of holders and of value, ordered from small to large, one row per distinct value."""
    keys = group or [ALL]
    src = df if group else df.withColumn(ALL, F.lit(1))
    counts = src.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(rows().alias("holders"))
    run = running_totals(counts, keys, [value], {"cum_holders": "holders",
                                                 "cum_value": (F.col("holders") * F.col(value)).cast("double")})
    totals = counts.groupBy(*keys).agg(F.sum("holders").alias("all_holders"),
                                       F.sum(F.col("holders") * F.col(value)).cast("double").alias("all_value"))
    return join_groups(run, small_side(totals), keys).select(
        *group, value, "holders", "cum_holders", "cum_value", "all_holders", "all_value",
        ratio("cum_holders", "all_holders").alias("holder_share"), ratio("cum_value", "all_value").alias("value_share"))


def gini(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """1 - 2 x area under the Lorenz points by trapezoids, first point at the first holder.

    Equal holders form one row; the trapezoids between them are summed in closed form, so the result equals the
    sum over single holders.
    """
    pts = lorenz(df, group, value)
    h, v = F.col("holders").cast("double"), F.col(value).cast("double")
    before = F.col("cum_value") - h * v
    # trapezoids ending at holders 1..h of this value: sum of (2 * before + (2 i - 1) v) / 2
    area = h * before + v * h * h / 2
    first = F.min_by(v, v)
    out = pts.groupBy(*group).agg(F.sum(area).alias("_a"), first.alias("_first"), F.max("all_holders").alias("holders"),
                                  F.max("all_value").alias("total"))
    # the curve has no segment before the first holder
    inner = F.col("_a") - F.col("_first") / 2
    return out.select(*group, "holders", "total",
                      (F.lit(1.0) - ratio(inner * 2, F.col("holders") * F.col("total"))).alias("gini"))


def top_shares(df: DataFrame, group: list[str], value: str, percents: list[int] = [1, 5, 10, 20, 50]) -> DataFrame:
    """Share of the total held by the largest x % of holders (at least one holder)."""
    pts = lorenz(df, group, value)
    # holders larger than this value, and what they hold together
    above = F.col("all_holders") - F.col("cum_holders")
    held_above = F.col("all_value") - F.col("cum_value")
    tops = F.explode(F.array(*[F.lit(p) for p in percents])).alias("top_percent")
    long = pts.select("*", tops).withColumn(
        "top_holders", F.greatest(F.lit(1), F.floor(F.col("all_holders") * F.col("top_percent") / 100)).cast("long"))
    hit = long.filter((above < F.col("top_holders")) & (above + F.col("holders") >= F.col("top_holders")))
    held = held_above + (F.col("top_holders") - above) * F.col(value)
    return hit.select(*group, "top_percent", "top_holders", held.cast("double").alias("held"),
                      ratio(held, "all_value", 100).alias("share_pct"))


def crosstab(df: DataFrame, row: str, columns: str, values: list[str]) -> DataFrame:
    """Counts with one column per listed value; the list fixes the output schema without a discovery job."""
    return df.groupBy(row).agg(*[F.count_if(F.col(columns) == v).alias(str(v)) for v in values])


def row_percent(table: DataFrame, row: str) -> DataFrame:
    cells = [c for c in table.columns if c != row]
    total = sum((F.col(c) for c in cells[1:]), F.col(cells[0]))
    return table.select(row, *[ratio(F.col(c), total, 100).alias(c) for c in cells])


def pivot_values(df: DataFrame, keys: list[str], column: str, values: list, agg, prefix: str = "") -> DataFrame:
    """Pivot with explicit values; ``agg`` maps a condition to an aggregate."""
    return df.groupBy(*keys).agg(*[agg(F.col(column) == v).alias(f"{prefix}{v}") for v in values])


def modes(df: DataFrame, group: list[str], column: str, name: str = "mode") -> DataFrame:
    """Most frequent value per group, the smallest on ties."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*group, column).agg(rows().alias("_n"))
    # smallest value among those with the highest count: two aggregates instead of an ordering of the group
    best = counts.groupBy(*group).agg(F.max("_n").alias("_top"))
    return join_groups(counts, best, group).filter("_n = _top").groupBy(*group).agg(F.min(column).alias(name))


def top_values(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    return (df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value"))
            .agg(rows().alias("count")).orderBy(F.desc("count"), "value").limit(top))


def growth(df: DataFrame, group: list[str], period: str, value: Column) -> DataFrame:
    """Totals per period and their percent change from the period before."""
    totals = df.groupBy(*group, period).agg(value.alias("total"))
    # one row per group and period
    w = Window.partitionBy(*group).orderBy(period)
    return totals.withColumn("growth_pct", (ratio("total", F.lag("total").over(w)) - 1) * 100)


def binned_trend(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Mean and median of ``y`` in equal-frequency bins of ``x``: the smooth trend on all rows."""
    src = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    edges = exact_quantiles(src, [], {f"e{i}": (x, i / bins) for i in range(1, bins)})
    cuts = edges.select(F.array(*[f"e{i}" for i in range(1, bins)])).scalar()
    binned = src.withColumn("_cuts", cuts).withColumn(
        "bin", F.size(F.filter("_cuts", lambda e: F.col(x) > e))).drop("_cuts")
    out = binned.groupBy("bin").agg(rows().alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))
    return join_groups(out, exact_quantiles(binned, ["bin"], {"median_y": (y, .5)}), ["bin"])


def trim_at(df: DataFrame, column: str, prob: float = 0.99) -> DataFrame:
    """Rows at or below the quantile; larger ones are dropped, not clipped."""
    cut = exact_quantiles(df, [], {"cut": (column, prob)})
    return df.filter(F.col(column) <= cut.scalar())


def winsorise(df: DataFrame, column: str, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    cut = exact_quantiles(df, [], {"lo": (column, lower), "hi": (column, upper)})
    lo, hi = cut.select("lo").scalar(), cut.select("hi").scalar()
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), lo), hi)))


def groups_with(df: DataFrame, group: list[str], at_least: int) -> DataFrame:
    """Rows of groups that hold at least ``at_least`` rows."""
    big = df.groupBy(*group).agg(rows().alias("_n")).filter(F.col("_n") >= at_least).drop("_n")
    return df.join(big, group, "left_semi")


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample variance of each column over complete rows."""
    return unpivot(df.dropna(subset=columns), [], columns, "dimension").groupBy("dimension").agg(
        F.var_samp("value").alias("variance"))


GROUP_LIMIT_ROWS = 1_000  # up to this limit Spark cuts ranked groups inside each task before the shuffle


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42, group: list[str] = []) -> DataFrame:
    """A repeatable sample of ``n`` rows, overall or per group, by hash order of the key."""
    tag = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    if not group:
        return df.orderBy(tag, key).limit(n)
    if n <= GROUP_LIMIT_ROWS:
        w = Window.partitionBy(*group).orderBy(tag, key)
        return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
    placed = positions(df.withColumn("_tag", tag), group, ["_tag", key], "_r")
    return placed.filter(F.col("_r") <= n).drop("_r", "_tag")


def rows_union(parts: list[DataFrame]) -> DataFrame:
    """Report rows stacked by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
