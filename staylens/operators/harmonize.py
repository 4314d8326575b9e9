"""Comparison of the same tables across cities."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import rows
from . import quality as Q
from .distribution import rows_union


def city_columns(tables: dict[str, DataFrame], kind: str = "listings") -> DataFrame:
    """(city, file type, column, dtype, null share, rows, columns) of one table per city."""
    parts = []
    for city, df in tables.items():
        types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
        parts.append(Q.completeness(df).select(
            F.lit(city).alias("city"), F.lit(kind).alias("file_type"), "column_name",
            types[F.col("column_name")].alias("dtype"), "null_pct", F.lit(len(df.columns)).alias("column_count")))
    return rows_union(parts)


def column_presence(columns: DataFrame, cities: int | None = None) -> DataFrame:
    """Per column: cities that have it, whether all do, and whether its type differs."""
    total = columns.groupBy("file_type").agg(F.count_distinct("city").alias("cities"))
    per = columns.groupBy("file_type", "column_name").agg(
        F.array_join(F.array_sort(F.collect_set("city")), ",").alias("present_in"), F.count_distinct("city").alias("n_cities"),
        F.count_distinct("dtype").alias("n_types"), F.min("null_pct").alias("min_null_pct"), F.max("null_pct").alias("max_null_pct"))
    return per.join(total, "file_type").select(
        "file_type", "column_name", "present_in", (F.col("n_cities") == F.col("cities")).alias("common"),
        (F.col("n_types") == 1).alias("consistent_type"), "min_null_pct", "max_null_pct")


def presence_summary(presence: DataFrame) -> DataFrame:
    return presence.groupBy("file_type").agg(
        rows().alias("total_unique_columns"), F.count_if("common").alias("common_columns"),
        F.count_if(~F.col("common")).alias("city_specific_columns"),
        F.count_if(F.col("common") & ~F.col("consistent_type")).alias("type_inconsistencies"))


def file_sizes(files: DataFrame, city_pattern: str) -> DataFrame:
    """Number and total size of files per city, the city taken from the path."""
    return files.groupBy(F.regexp_extract("path", city_pattern, 1).alias("city")).agg(
        rows().alias("files"), F.sum("length").alias("total_size_bytes"))


def harmonization_report(tables: dict[str, dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """``tables`` maps city to its tables by kind; at least two cities are compared."""
    if len(tables) < 2:
        raise ValueError("at least two cities are needed")
    kinds = sorted({k for t in tables.values() for k in t})
    cols = rows_union([city_columns({c: t[k] for c, t in tables.items() if k in t}, k) for k in kinds])
    presence = column_presence(cols)
    return {"columns": cols, "presence": presence, "summary": presence_summary(presence)}
