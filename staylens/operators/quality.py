"""Row flags, rule reports, duplicate and outlier checks, coverage and completeness."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings
from ..functions.rounding import ratio, stable_round
from .joins import small_side
from .ordering import exact_quantiles, join_groups


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _broken(df: DataFrame, name: str, rule: dict) -> Column | None:
    """Condition under which a row breaks ``rule``; None when the rule does not apply to the column."""
    x, check = F.col(name), rule["check"]
    if check == "not_null":
        return x.isNull()
    if check == "positive":
        return (x <= 0) if is_numeric(df, name) else None
    if check == "range":
        low, high = rule.get("min"), rule.get("max")
        if not is_numeric(df, name) or (low is None and high is None):
            return None
        below = F.lit(False) if low is None else x < low
        above = F.lit(False) if high is None else x > high
        return below | above
    if check == "enum":
        return ~x.isin(rule["values"]) if rule.get("values") else None
    if check == "regex":
        return ~x.rlike(rule["pattern"]) if is_text(df, name) else None
    return None


def validation_flags(df: DataFrame, rules: dict[str, list[dict]],
                     extra: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``_validation_flags`` (failed rules, sorted, joined by ``|``) and ``_is_valid``.

    ``extra`` adds rules of the caller: flag name to the condition that breaks it.
    """
    broken = {f"{name}_{rule['check']}": _broken(df, name, rule)
              for name, specs in rules.items() if name in df.columns for rule in specs}
    broken.update(extra or {})
    flags = [F.when(cond, F.lit(flag)) for flag, cond in sorted(broken.items()) if cond is not None]
    text = F.concat_ws("|", *flags) if flags else F.lit("")
    return df.withColumn("_validation_flags", text).withColumn("_is_valid", F.col("_validation_flags") == "")


def rule_report(df: DataFrame, rules: dict[str, dict], examples: bool = False) -> DataFrame:
    """One row per column and rule: rows checked, violations, passed.

    All rules except uniqueness are counted in a single pass; each unique rule adds one distinct count.
    A column that is missing altogether gets the failed rule ``exists``.
    """
    spark = df.sparkSession
    checks: list[tuple[str, str, Column]] = []
    missing = [c for c in rules if c not in df.columns]
    for name, spec in rules.items():
        if name in missing:
            continue
        for rule, arg in spec.items():
            if rule == "unique":
                checks.append((name, rule, F.count(name) - F.count_distinct(name)))
                continue
            one = {"check": rule}
            if rule == "range":
                one.update(arg)
            elif rule == "enum":
                if not is_text(df, name):
                    continue
                one["values"] = arg
            elif rule == "regex":
                one["pattern"] = arg
            cond = _broken(df, name, one)
            if cond is not None:
                checks.append((name, rule, F.count_if(cond)))
    wide = df.agg(F.count(F.lit(1)).alias("total"), *[c.alias(f"v{i}") for i, (_, _, c) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("rule"),
                              F.col(f"v{i}").cast("long").alias("violations")) for i, (c, r, _) in enumerate(checks)],
                   *[F.struct(F.lit(c).alias("column_name"), F.lit("exists").alias("rule"),
                              F.lit(1).cast("long").alias("violations")) for c in missing]
                   ).cast("array<struct<column_name:string,rule:string,violations:bigint>>")
    out = wide.select(F.col("total").alias("total_rows"), F.inline(rows)).select(
        "column_name", "rule", "total_rows", "violations",
        F.when(F.col("rule") != "exists",
               stable_round(ratio("violations", "total_rows", 100), 2)).alias("violation_pct"),
        (F.col("violations") == 0).alias("passed"))
    if not examples:
        return out
    lists = [(c, s["enum"]) for c, s in rules.items() if "enum" in s and c in df.columns and is_text(df, c)]
    odd = None
    for name, allowed in lists:
        one = (df.filter(~F.col(name).isin(allowed)).groupBy(F.lit(name).alias("column_name"),
                                                             F.col(name).alias("v")).count()
               .orderBy("v").limit(5)
               .groupBy("column_name").agg(F.array_sort(F.collect_list("v")).alias("unexpected")))
        odd = one if odd is None else odd.unionAll(one)
    if odd is None:
        return out.withColumn("unexpected", F.lit(None).cast("array<string>"))
    odd = odd.withColumn("rule", F.lit("enum"))
    return out.join(odd, ["column_name", "rule"], "left")


def rule_summary(report: DataFrame) -> DataFrame:
    """Columns checked, passed and failed."""
    per_column = report.groupBy("column_name").agg(F.bool_and("passed").alias("ok"))
    return per_column.agg(F.count(F.lit(1)).alias("rules_checked"), F.count_if("ok").alias("rules_passed"),
                          F.count_if(~F.col("ok")).alias("rules_failed"))


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unique keys, keys held by several rows, and surplus rows; ``checked`` is false without key columns."""
    present = [k for k in keys if k in df.columns]
    if not present:
        return df.sparkSession.createDataFrame(
            [(",".join(keys), False, None, None, None, None)],
            "key_columns string, checked boolean, total_rows long, unique_keys long, duplicate_keys long, "
            "duplicate_rows long")
    return key_counts(df, present).agg(
        F.lit(",".join(present)).alias("key_columns"), F.lit(True).alias("checked"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("unique_keys"),
        F.count_if(F.col("copies") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("copies") - 1)), F.lit(0)).alias("duplicate_rows"))


def worst_duplicates(df: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    return key_counts(df, keys).filter("copies > 1").orderBy(F.desc("copies"), *keys).limit(top)


def artifact_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with HTML tags and with broken encoding, per text column, in one pass."""
    names = [c for c in (columns or df.columns) if is_text(df, c)]
    wide = df.agg(*[F.count_if(F.col(c).rlike(p)).alias(f"{k}_{i}") for i, c in enumerate(names)
                    for k, p in (("h", settings.HTML_TAG_PATTERN), ("e", settings.MOJIBAKE_PATTERN))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"h_{i}").alias("html_tags"),
                              F.col(f"e_{i}").alias("encoding_artifacts")) for i, c in enumerate(names)])
    return wide.select(F.inline(rows))


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULLs, NULL share and fill rate of every column, in one pass."""
    names = columns or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col("n") - F.col(f"c{i}")).alias("null_count"))
                     for i, c in enumerate(names)])
    pct = stable_round(ratio("null_count", "n", 100), 2)
    return wide.select("n", F.inline(rows)).select(
        "column_name", "null_count", pct.alias("null_pct"), stable_round(F.lit(100.0) - pct, 2).alias("fill_rate_pct"))


def listings_coverage(df: DataFrame, area="neighbourhood_cleansed", host="host_id", price="price",
                      last_review="last_review") -> DataFrame:
    n = F.count(F.lit(1))
    hosts = _distinct_with_null(host)
    return df.agg(_distinct_with_null(area).alias("unique_neighbourhoods"), hosts.alias("unique_hosts"),
                  stable_round(ratio(n, hosts), 2).alias("listings_per_host_mean"),
                  stable_round(ratio(F.count(price), n, 100), 2).alias("price_fill_rate_pct"),
                  stable_round(ratio(F.count(last_review), n, 100), 2).alias("listings_with_reviews_pct"))


def _distinct_with_null(name: str) -> Column:
    """Distinct values with NULL counted as one more value."""
    return F.count_distinct(name) + F.max(F.col(name).isNull().cast("long"))


def calendar_coverage(df: DataFrame, listing="listing_id", day="date", available="available") -> DataFrame:
    """Distinct listings, date span, available share among days with a known state."""
    d = F.try_to_date(F.col(day), "yyyy-MM-dd") if is_text(df, day) else F.col(day)
    open_ = (F.col(available) == "t") if is_text(df, available) else F.col(available)
    shut = (F.col(available) == "f") if is_text(df, available) else ~F.col(available)
    known = F.count_if(open_) + F.count_if(shut)
    return df.agg(_distinct_with_null(listing).alias("unique_listings"), F.min(d).alias("min_date"),
                  F.max(d).alias("max_date"), F.datediff(F.max(d), F.min(d)).alias("span_days"),
                  stable_round(ratio(F.count_if(open_), known, 100), 2).alias("available_pct"),
                  stable_round(ratio(F.count_if(shut), known, 100), 2).alias("unavailable_pct"))


def reviews_coverage(df: DataFrame, listing="listing_id", reviewer="reviewer_id", day="date") -> DataFrame:
    d = F.try_to_date(F.col(day), "yyyy-MM-dd") if is_text(df, day) else F.col(day)
    return df.agg(_distinct_with_null(listing).alias("unique_listings_reviewed"),
                  _distinct_with_null(reviewer).alias("unique_reviewers"), F.min(d).alias("min_date"),
                  F.max(d).alias("max_date"), F.datediff(F.max(d), F.min(d)).alias("span_days"))


def outliers_iqr(df: DataFrame, columns: list[str], k: float = 1.5, group: list[str] | None = None) -> DataFrame:
    """Quartile fences per column with the number and share of values outside them."""
    group = group or []
    names = [c for c in columns if c in df.columns and is_numeric(df, c)]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in names])
    long = df.select(*group, F.inline(rows)).filter("v IS NOT NULL")
    fences = exact_quantiles(long, [*group, "column_name"], {"q1": ("v", 0.25), "q3": ("v", 0.75)})
    fences = fences.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("lower_bound", F.col("q1") - F.lit(k) * F.col("iqr")) \
        .withColumn("upper_bound", F.col("q3") + F.lit(k) * F.col("iqr"))
    keys = [*group, "column_name"]
    values = long.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    joined = join_groups(values, small_side(fences), keys, "inner")
    outside = (F.col("v") < F.col("lower_bound")) | (F.col("v") > F.col("upper_bound"))
    return joined.groupBy(*keys, "q1", "q3", "iqr", "lower_bound", "upper_bound").agg(
        F.sum("n").alias("total_non_null"),
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outlier_count")) \
        .withColumn("outlier_pct", stable_round(ratio("outlier_count", "total_non_null", 100), 2))


def outlier_examples(df: DataFrame, column: str, k: float = 1.5, top: int = 10) -> DataFrame:
    """The ``top`` largest values outside the fences."""
    fences = exact_quantiles(df, [], {"q1": (column, 0.25), "q3": (column, 0.75)})
    lo = fences.select(F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1"))).scalar()
    hi = fences.select(F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1"))).scalar()
    out = df.filter((F.col(column) < lo) | (F.col(column) > hi))
    return out.select(F.col(column).alias("outlier")).orderBy(F.desc("outlier")).limit(top)


def quality_score(completeness_by_file: DataFrame) -> DataFrame:
    """Mean fill rate over columns of a file, then over files; critical columns more than half empty."""
    per_file = completeness_by_file.groupBy("file_name").agg(
        F.avg("fill_rate_pct").alias("fill"),
        F.count_if((F.col("null_pct") > 50) & F.col("column_name").isin(settings.CRITICAL_COLUMNS)).alias("critical"))
    return per_file.agg(stable_round(F.avg("fill"), 1).alias("overall_score"), F.sum("critical").alias("critical_issues"))
