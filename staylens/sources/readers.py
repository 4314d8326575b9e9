"""Scans of raw files, staged tables and small configured tables."""

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings

log = logging.getLogger(__name__)

# fixed values: file stem -> logical table
FILE_TYPES = {"listings": "listings", "calendar": "calendar", "reviews": "reviews",
              "neighbourhoods": "neighbourhoods", "neighborhoods": "neighbourhoods"}
# fixed values: columns that guests and hosts write themselves
FREE_TEXT = frozenset(["name", "description", "neighborhood_overview", "neighbourhood_overview", "host_about", "host_name", "host_location",
                       "reviewer_name", "comments", "license", "amenities", "summary", "notes", "house_rules"])


def blank_tokens_to_null(df: DataFrame, tokens: list[str] = settings.NULL_TOKENS) -> DataFrame:
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(tokens), F.col(c)) for c in strings})


def has_free_text(columns: list[str]) -> bool:
    """Whether a value may hold line breaks; only then must one file be one task."""
    return bool(FREE_TEXT.intersection(columns))


def read_raw(spark: SparkSession, path, columns: list[str] | None = None, spread: int | None = None) -> DataFrame:
    """CSV or CSV.GZ with a header; every column text, no type inference.

    Without ``columns`` the names come from the header line alone (one line is read).  A gzip file is one task,
    so ``spread`` hands its rows to that many partitions right after the read.
    """
    if columns is None:
        columns = header_of(spark, path)
    reader = (spark.read.option("header", True).option("multiLine", has_free_text(columns)).option("escape", '"')
              .option("mode", "PERMISSIVE"))
    df = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)
    if spread:
        df = df.repartition(spread)
    return blank_tokens_to_null(df)


def header_of(spark: SparkSession, path) -> list[str]:
    first = path[0] if isinstance(path, (list, tuple)) else path
    return spark.read.option("header", True).option("escape", '"').csv(first).columns


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path``, ``length``, ``modificationTime`` of the files below ``folder``; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(folder)
            .select("path", "length", "modificationTime"))


def resolve_sources(files: DataFrame) -> DataFrame:
    """One file per folder and base name, ``.csv.gz`` before ``.csv``, with its logical table."""
    named = files.select(
        "*", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"),
        F.regexp_extract("path", r"([^/]+?)\.csv(\.gz)?$", 1).alias("base"),
        F.col("path").endswith(".gz").alias("zipped")).filter("base <> ''")
    best = named.groupBy("folder", "base").agg(
        F.max_by(F.struct("path", "length"), F.struct("zipped", "path")).alias("pick"))
    kind = F.lit("unknown")
    for stem, name in FILE_TYPES.items():
        kind = F.when(F.lower("base") == stem, F.lit(name)).otherwise(kind)
    return best.select("folder", "base", F.col("pick.path").alias("path"), F.col("pick.length").alias("length"),
                       kind.alias("file_type"))


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
    """Parquet when the path exists; otherwise an empty table of ``schema``, or None without one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err.getCondition()):
            raise
        log.warning("optional input %s is absent", path)
        return None if schema is None else empty_table(spark, schema)


def scan_union_by_name(spark: SparkSession, paths: list[str], city_pattern: str | None = None) -> DataFrame:
    """Many Parquet files with columns matched by name; the city taken from each file's path."""
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    if city_pattern:
        df = df.withColumn("city", F.regexp_extract(F.col("_metadata.file_path"), city_pattern, 1))
    return df


def empty_table(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def city_dimension(spark: SparkSession, names: list[str] | None = None,
                   cities: dict = settings.CITIES) -> DataFrame:
    """``dim_city`` from the configured cities, keyed from 1 in the order given."""
    names = names or list(cities)
    rows = [(i, n, cities[n].get("display_name", n), cities[n].get("country", ""),
             cities[n].get("currency_code", "USD"), cities[n].get("currency_symbol", ""),
             cities[n].get("timezone", "")) for i, n in enumerate(names, 1)]
    return spark.createDataFrame(rows, "city_key int, city_name string, display_name string, country string, "
                                       "currency_code string, currency_symbol string, timezone string")


def city_context(spark: SparkSession, cities: dict = settings.CITIES, rates: dict = settings.USD_RATES) -> DataFrame:
    """City attributes, snapshot date and USD rate, one row per configured city."""
    import datetime as dt
    rows = []
    for name, c in cities.items():
        day = c.get("scrape_date")
        rows.append((name, c.get("display_name", name), c.get("country", ""), c.get("currency_code", "USD"),
                     c.get("currency_symbol", ""), c.get("timezone", ""),
                     dt.date.fromisoformat(str(day)) if day else None,
                     float(rates.get(c.get("currency_code", "USD"), 1.0))))
    return spark.createDataFrame(rows, "city string, city_display_name string, country string, currency_code string, "
                                       "currency_symbol string, timezone string, scrape_date date, usd_rate double")


def date_series(bounds: DataFrame, first: str, last: str, name: str = "full_date") -> DataFrame:
    """Every day from ``first`` to ``last`` of a one-row table of bounds."""
    return bounds.filter(F.col(first).isNotNull()).select(
        F.explode(F.sequence(F.col(first), F.col(last), F.expr("INTERVAL 1 DAY"))).alias(name))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature of a GeoJSON feature collection."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.explode("features").alias("feature")).select("feature.properties.*",
                                                                      F.col("feature.geometry").alias("geometry"))


def read_master(spark: SparkSession, path: str, city: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("city") == city) if city else df


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each named table."""
    parts = [df.groupBy().agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
