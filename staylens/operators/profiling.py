"""Column profiles by type, schema rows, quality and validation reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings
from ..functions.parsing import schema_hash
from ..functions.rounding import ratio, rows, stable_round
from . import quality as Q
from .distribution import rows_union
from .ordering import exact_quantiles, join_groups


def columns_of(df: DataFrame, kind) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """min, max, mean, median, std and quartiles (linear) per numeric column, in one long pass."""
    names = columns or columns_of(df, T.NumericType)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in names])
    long = df.select(F.inline(cells)).filter("v IS NOT NULL")
    base = long.groupBy("column_name").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), stable_round(F.avg("v"), 4).alias("mean"),
        stable_round(F.stddev_samp("v"), 4).alias("std"))
    qs = exact_quantiles(long, ["column_name"], {"q25": ("v", .25), "median": ("v", .5), "q75": ("v", .75)})
    return join_groups(base, qs, ["column_name"])


def text_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or columns_of(df, T.StringType)
    wide = df.agg(*[e for i, c in enumerate(names) for e in (
        F.min(F.length(c)).alias(f"a{i}"), F.max(F.length(c)).alias(f"b{i}"), F.avg(F.length(c)).alias(f"c{i}"))])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"a{i}").alias("min_length"),
                               F.col(f"b{i}").alias("max_length"),
                               stable_round(F.col(f"c{i}"), 1).alias("avg_length")) for i, c in enumerate(names)])
    return wide.select(F.inline(cells))


def date_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or columns_of(df, (T.DateType, T.TimestampType, T.TimestampNTZType))
    wide = df.agg(*[e for i, c in enumerate(names) for e in (F.min(c).cast("date").alias(f"a{i}"),
                                                             F.max(c).cast("date").alias(f"b{i}"))])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"a{i}").alias("min_date"), F.col(f"b{i}").alias("max_date"),
                               F.datediff(F.col(f"b{i}"), F.col(f"a{i}")).alias("date_range_days"))
                      for i, c in enumerate(names)])
    return wide.select(F.inline(cells))


def uniqueness(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct values per column and their share of the non-NULL rows.

    Values are counted per (column, value) first, so each column's distinct count is spread over all tasks; the
    approximate form keeps one sketch per column instead.
    """
    names = columns or df.columns
    if approximate:
        wide = df.agg(*[e for i, c in enumerate(names) for e in (
            F.approx_count_distinct(c, 0.01).alias(f"u{i}"), F.count(c).alias(f"n{i}"))])
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"u{i}").alias("unique_count"),
                                   F.col(f"n{i}").alias("non_null")) for i, c in enumerate(names)])
        out = wide.select(F.inline(cells))
    else:
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in names])
        values = df.select(F.inline(cells)).groupBy("column_name", "v").agg(rows().alias("n"))
        out = values.groupBy("column_name").agg(F.count("v").alias("unique_count"),
                                                F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"))
    return out.select("column_name", "unique_count", F.coalesce(
        stable_round(ratio("unique_count", "non_null", 100), 2), F.lit(0.0)).alias("unique_pct"))


def top_values_per_column(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """Most frequent values of several columns at once."""
    from pyspark.sql import Window
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(cells)).filter("value IS NOT NULL").groupBy("column_name", "value").agg(rows().alias("count"))
    w = Window.partitionBy("column_name").orderBy(F.desc("count"), "value")  # limit per task before the shuffle
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def sample_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """``k`` non-NULL values of each column, found by a limited scan per column."""
    return rows_union([df.filter(F.col(c).isNotNull()).select(F.lit(c).alias("column_name"),
                                                              F.col(c).cast("string").alias("sample")).limit(k) for c in columns])


def schema_rows(df: DataFrame, name: str = "") -> DataFrame:
    """One row per column: type, position, NULLs, plus the table's size and fingerprint."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kind = F.create_map(*[x for c, t in types.items() for x in (F.lit(c), F.lit(t))])
    return Q.completeness(df).select(
        F.lit(name).alias("table_name"), "column_name", kind[F.col("column_name")].alias("dtype"), "null_count", "null_pct",
        F.lit(len(types)).alias("column_count"), F.lit(schema_hash(list(types))).alias("schema_hash"))


def profile(df: DataFrame, name: str = "") -> dict[str, DataFrame]:
    """Schema, uniqueness and the profile that fits each column's type."""
    out = {"schema": schema_rows(df, name), "uniqueness": uniqueness(df)}
    numeric, text = columns_of(df, T.NumericType), columns_of(df, T.StringType)
    dates = columns_of(df, (T.DateType, T.TimestampType, T.TimestampNTZType))
    if numeric:
        out["numeric"] = numeric_profile(df, numeric)
    if text:
        out["text"] = text_profile(df, text)
        out["top_values"] = top_values_per_column(df, text)
    if dates:
        out["dates"] = date_profile(df, dates)
    return out


def completeness_by_file(tables: dict[str, DataFrame]) -> DataFrame:
    return rows_union([Q.completeness(df).select(F.lit(k).alias("file_name"), "*") for k, df in tables.items()])


def quality_report(tables: dict[str, DataFrame], targets: dict[str, list[str]] = settings.OUTLIER_TARGETS) -> dict[str, DataFrame]:
    """Profiles, outliers, completeness per table and the overall score."""
    comp = completeness_by_file(tables)
    outliers = [Q.outliers_iqr(df, targets[k]).select(F.lit(k).alias("file_name"), "*") for k, df in tables.items()
                if any(c in df.columns and Q.is_numeric(df, c) for c in targets.get(k, []))]
    out = {"completeness": comp, "score": Q.quality_score(comp)}
    if outliers:
        out["outliers"] = rows_union(outliers)
    return out


def validation_report(tables: dict[str, DataFrame], rules: dict[str, dict] = settings.REPORT_RULES) -> dict[str, DataFrame]:
    """Rules, duplicates, artifacts and a summary row per table."""
    report = rows_union([Q.rule_report(df, rules.get(k, {})).select(F.lit(k).alias("file_type"), "*")
                         for k, df in tables.items() if rules.get(k)])
    dups = rows_union([Q.duplicate_report(df, settings.PRIMARY_KEYS.get(k, [])).select(F.lit(k).alias("file_type"), "*")
                       for k, df in tables.items()])
    arts = rows_union([Q.artifact_report(df).select(F.lit(k).alias("file_type"), "*") for k, df in tables.items()
                       if columns_of(df, T.StringType)])
    per_column = report.groupBy("file_type", "column_name").agg(F.bool_and("passed").alias("ok"))
    counts = per_column.groupBy("file_type").agg(rows().alias("rules_checked"), F.count_if("ok").alias("rules_passed"),
                                                 F.count_if(~F.col("ok")).alias("rules_failed"))
    marks = arts.groupBy("file_type").agg(F.bool_or((F.col("html_tags") > 0) | (F.col("encoding_artifacts") > 0)).alias("has_artifacts"))
    summary = counts.join(dups.select("file_type", (F.col("duplicate_keys") > 0).alias("has_duplicates")), "file_type", "left") \
        .join(marks, "file_type", "left")
    return {"rules": report, "duplicates": dups, "artifacts": arts, "summary": summary}
