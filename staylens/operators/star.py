"""Star schema: six dimensions and three facts from the gold table and the silver events."""

import logging
from collections.abc import ItemsView, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings
from ..functions.bands import date_parts
from ..functions.parsing import cast_first, coalesce_present
from ..functions.rounding import stable_round
from ..sources.readers import city_dimension, date_series, empty_table, row_counts
from ..sources.sinks import write_table
from .joins import join_to_unique
from .ordering import dense_keys

log = logging.getLogger(__name__)

DATE_SCHEMA = ("date_key int, full_date date, year smallint, quarter tinyint, month tinyint, day_of_month tinyint, "
               "day_of_week tinyint, day_name string, month_name string, is_weekend boolean, week_of_year tinyint")
REVIEWER_SCHEMA = "reviewer_key bigint, reviewer_id bigint, reviewer_name string"
CALENDAR_SCHEMA = ("listing_key bigint, date_key int, is_available boolean, price_local double, price_usd double, "
                   "adjusted_price double, minimum_nights int, maximum_nights int")
REVIEW_SCHEMA = "review_id bigint, listing_key bigint, reviewer_key bigint, review_date_key int, comment_length int"

# partitions of the stored calendar fact: queries on one city or a span of months read their files only
CALENDAR_LAYOUT = {"fact_city": "city_key", "fact_month": "year(full_date) * 100 + month(full_date)"}

# one value per key: text takes the smallest value present, so that the result does not depend on row order
ANY, MIN, MAX = F.min, F.min, F.max


def _either(c: Column) -> Column:
    return F.bool_or(F.coalesce(c, F.lit(False)))


def _dedupe(df: DataFrame, keys: dict[str, Column], columns: dict[str, tuple]) -> DataFrame:
    """One row per natural key; ``columns`` maps name to (aggregate, expression)."""
    base = df.select(*[e.alias(n) for n, e in keys.items()], *[e.alias(n) for n, (_, e) in columns.items()])
    for k in keys:
        base = base.filter(F.col(k).isNotNull())
    return base.groupBy(*keys).agg(*[agg(F.col(n)).alias(n) for n, (agg, _) in columns.items()])


def dim_date(spark: SparkSession, gold: DataFrame, calendar: DataFrame | None = None,
             reviews: DataFrame | None = None) -> DataFrame:
    """Every day between the first and the last date of any source."""
    days = gold.select(cast_first(gold, ["scrape_date"], "date").alias("d"))
    for side in (calendar, reviews):
        if side is not None:
            days = days.unionAll(side.select(cast_first(side, ["date"], "date").alias("d")))
    bounds = days.agg(F.min("d").alias("first"), F.max("d").alias("last"))
    return date_series(bounds, "first", "last").select(*[e.alias(n) for n, e in date_parts("full_date").items()])


def dim_host(gold: DataFrame) -> DataFrame:
    def first(names, kind):
        return cast_first(gold, names, kind)
    cols = {
        "host_name": (ANY, first(["host_name"], "string")), "host_since": (MIN, first(["host_since"], "date")),
        "host_location": (ANY, first(["host_location"], "string")),
        "host_response_time": (ANY, first(["host_response_time"], "string")),
        "host_response_rate": (MAX, first(["host_response_rate"], "double")),
        "host_acceptance_rate": (MAX, first(["host_acceptance_rate"], "double")),
        "host_is_superhost": (_either, first(["host_is_superhost"], "boolean")),
        "host_listings_count": (MAX, coalesce_present(
            gold, ["host_listings_count", "calculated_host_listings_count"], "int")),
        "host_total_listings_count": (MAX, first(["host_total_listings_count"], "int")),
        "host_has_profile_pic": (_either, first(["host_has_profile_pic"], "boolean")),
        "host_identity_verified": (_either, first(["host_identity_verified"], "boolean")),
        "host_verification_count": (MAX, first(["host_verification_count"], "int")),
        "is_professional_host": (_either, first(["is_professional_host"], "boolean")),
        "host_tenure_years": (MAX, first(["host_tenure_years"], "double")),
    }
    return dense_keys(_dedupe(gold, {"host_id": first(["host_id"], "bigint")}, cols), ["host_id"], "host_key")


def dim_property(gold: DataFrame) -> DataFrame:
    def first(names, kind):
        return cast_first(gold, names, kind)
    cols = {n: (ANY, first([n], "string")) for n in ("listing_url", "name", "description", "property_type", "room_type")}
    cols.update({"accommodates": (MAX, first(["accommodates"], "int")), "bathrooms": (MAX, first(["bathrooms"], "double")),
                 "bathrooms_shared": (_either, first(["bathrooms_shared"], "boolean")),
                 "bedrooms": (MAX, first(["bedrooms"], "int")), "beds": (MAX, first(["beds"], "int")),
                 "amenities": (ANY, first(["amenities"], "string")),
                 "amenity_count": (MAX, first(["amenity_count"], "int")),
                 "instant_bookable": (_either, first(["instant_bookable"], "boolean")),
                 "license": (ANY, first(["license", "licence"], "string"))})
    key = {"listing_id": coalesce_present(gold, ["listing_id", "id"], "bigint")}
    return dense_keys(_dedupe(gold, key, cols), ["listing_id"], "property_key")


def area_name(gold: DataFrame) -> Column:
    return coalesce_present(gold, ["neighbourhood_cleansed", "neighbourhood_name", "neighbourhood"], "string")


def dim_neighbourhood(gold: DataFrame) -> DataFrame:
    def first(names, kind):
        return cast_first(gold, names, kind)
    cols = {"neighbourhood_group": (ANY, coalesce_present(
                gold, ["neighbourhood_group", "neighbourhood_group_cleansed"], "string")),
            "listing_count": (MAX, first(["neighbourhood_listing_count"], "int")),
            "median_price": (MAX, first(["neighbourhood_median_price"], "double")),
            "mean_price": (MAX, first(["neighbourhood_mean_price"], "double")),
            "avg_rating": (MAX, first(["neighbourhood_avg_rating"], "double")),
            "avg_availability": (MAX, first(["neighbourhood_avg_availability"], "double"))}
    keys = {"city": first(["city"], "string"), "neighbourhood_name": area_name(gold)}
    return dense_keys(_dedupe(gold, keys, cols), ["city", "neighbourhood_name"], "neighbourhood_key")


def dim_reviewer(spark: SparkSession, reviews: DataFrame | None) -> DataFrame:
    if reviews is None:
        return empty_table(spark, REVIEWER_SCHEMA)
    cols = {"reviewer_name": (ANY, cast_first(reviews, ["reviewer_name"], "string"))}
    unique = _dedupe(reviews, {"reviewer_id": cast_first(reviews, ["reviewer_id"], "bigint")}, cols)
    return dense_keys(unique, ["reviewer_id"], "reviewer_key")


# fixed values: measures of the snapshot fact
FACT_DOUBLES = ["price_usd", "latitude", "longitude"]
FACT_INTS = ["minimum_nights", "maximum_nights", "number_of_reviews", "number_of_reviews_ltm"]
FACT_SCORES = ["review_scores_rating", *settings.SUB_SCORES, "reviews_per_month"]
FACT_WINDOWS = ["availability_30", "availability_60", "availability_90", "availability_365"]
FACT_MONEY = ["occupancy_rate_pct", "estimated_annual_revenue", "estimated_monthly_revenue", "avg_booked_price",
              "price_per_bedroom", "price_per_person", "price_vs_neighbourhood", "host_tenure_years"]
FACT_FLAGS = ["is_active", "is_professional_host"]


def fact_listing_snapshot(gold: DataFrame, hosts: DataFrame, properties: DataFrame, areas: DataFrame,
                          cities: DataFrame, dates: DataFrame) -> DataFrame:
    def first(name, kind):
        return cast_first(gold, [name], kind).alias(name)
    base = gold.select(
        coalesce_present(gold, ["listing_id", "id"], "bigint").alias("listing_id"), first("host_id", "bigint"),
        first("city", "string"), area_name(gold).alias("neighbourhood_name"),
        cast_first(gold, ["scrape_date"], "date").alias("full_date"),
        coalesce_present(gold, ["price_local", "price"], "double").alias("price_local"),
        *[first(c, "double") for c in FACT_DOUBLES], *[first(c, "int") for c in FACT_INTS],
        *[first(c, "double") for c in FACT_SCORES], *[first(c, "int") for c in FACT_WINDOWS],
        *[first(c, "double") for c in FACT_MONEY], *[first(c, "boolean") for c in FACT_FLAGS],
    ).filter("listing_id IS NOT NULL")
    # every dimension has one row per natural key, so the joins keep the grain; sizes decide broadcast at run time
    keyed = (join_to_unique(base, hosts.select("host_id", "host_key"), ["host_id"])
             .join(properties.select("listing_id", "property_key"), "listing_id", "left")
             .join(areas.select("city", "neighbourhood_name", "neighbourhood_key"), ["city", "neighbourhood_name"], "left")
             .join(cities.select(F.col("city_name").alias("city"), "city_key"), "city", "left")
             .join(dates.select("full_date", F.col("date_key").alias("snapshot_date_key")), "full_date", "left"))
    numbered = dense_keys(keyed, ["city", "listing_id"], "listing_key")
    return numbered.select("listing_key", "listing_id", "host_key", "property_key", "neighbourhood_key", "city_key",
                           "snapshot_date_key", "price_local", *FACT_DOUBLES, *FACT_INTS, *FACT_SCORES,
                           *FACT_WINDOWS, *FACT_MONEY, *FACT_FLAGS)


def _snapshot_by_city(snapshot: DataFrame, cities: DataFrame) -> DataFrame:
    return (snapshot.select("listing_id", "city_key", "listing_key")
            .join(cities.select("city_key", F.col("city_name").alias("city")), "city_key")
            .select("listing_id", "city", "listing_key", "city_key"))


def usd_rate_of(spark: SparkSession, cities: dict = settings.CITIES, rates: dict = settings.USD_RATES) -> DataFrame:
    return spark.createDataFrame([(n, float(rates.get(str(c.get("currency_code", "USD")), 1.0)))
                                  for n, c in cities.items()], "city string, usd_rate double")


def fact_calendar(spark: SparkSession, calendar: DataFrame | None, snapshot: DataFrame, cities: DataFrame,
                  dates: DataFrame, config: dict = settings.CITIES, with_layout: bool = False) -> DataFrame:
    """Calendar days with their listing's key; ``with_layout`` adds the columns of ``CALENDAR_LAYOUT``.

    A listing has one row per day and scrape, so no key is hot enough to be worth a counting pass.
    """
    layout = [n for n in CALENDAR_LAYOUT if with_layout]
    if calendar is None:
        return empty_table(spark, CALENDAR_SCHEMA + "".join(f", {n} int" for n in layout))
    days = calendar.select(
        cast_first(calendar, ["listing_id"], "bigint").alias("listing_id"), cast_first(calendar, ["city"], "string").alias("city"),
        cast_first(calendar, ["date"], "date").alias("full_date"),
        cast_first(calendar, ["available"], "boolean").alias("is_available"),
        cast_first(calendar, ["price_local", "price"], "double").alias("price_local"),
        cast_first(calendar, ["adjusted_price_local", "adjusted_price"], "double").alias("adjusted_price"),
        cast_first(calendar, ["minimum_nights"], "int").alias("minimum_nights"),
        cast_first(calendar, ["maximum_nights"], "int").alias("maximum_nights"))
    joined = (join_to_unique(days, _snapshot_by_city(snapshot, cities), ["listing_id", "city"], hot_rows=None)
              .join(F.broadcast(usd_rate_of(spark, config)), "city", "left")  # one row per configured city
              .join(dates.select("full_date", "date_key"), "full_date", "left"))
    return joined.select("listing_key", "date_key", "is_available", "price_local",
                         stable_round(F.col("price_local") * F.coalesce("usd_rate", F.lit(1.0)), 2).alias("price_usd"),
                         "adjusted_price", "minimum_nights", "maximum_nights", *[F.expr(CALENDAR_LAYOUT[n]).cast("int").alias(n) for n in layout])


def fact_review(spark: SparkSession, reviews: DataFrame | None, snapshot: DataFrame, reviewers: DataFrame,
                cities: DataFrame, dates: DataFrame) -> DataFrame:
    if reviews is None:
        return empty_table(spark, REVIEW_SCHEMA)
    events = reviews.select(
        cast_first(reviews, ["review_id", "id"], "bigint").alias("review_id"),
        cast_first(reviews, ["listing_id"], "bigint").alias("listing_id"), cast_first(reviews, ["city"], "string").alias("city"),
        cast_first(reviews, ["date"], "date").alias("full_date"),
        cast_first(reviews, ["reviewer_id"], "bigint").alias("reviewer_id"),
        (F.length("comments") if "comments" in reviews.columns else F.lit(None)).cast("int").alias("comment_length"))
    if not events.filter("review_id IS NULL").isEmpty():  # each row without an id takes its row number
        numbered = dense_keys(events, ["city", "listing_id", "full_date", "reviewer_id", "comment_length", "review_id"], "_row")
        events = numbered.withColumn("review_id", F.coalesce("review_id", "_row")).drop("_row")
    placed = join_to_unique(events, _snapshot_by_city(snapshot, cities), ["listing_id", "city"])
    joined = (join_to_unique(placed, reviewers.select("reviewer_id", "reviewer_key"), ["reviewer_id"])
              .join(dates.select("full_date", F.col("date_key").alias("review_date_key")), "full_date", "left"))
    return joined.select("review_id", "listing_key", "reviewer_key", "review_date_key", "comment_length")


class StarTables(Mapping):
    """The nine tables, each built on first use after those it reads; with ``path`` it is written before it is read.

    Thus a query on dimensions does not wait for the calendar fact.  Tables asked for together are built at the same time
    where they do not depend on each other; going through all items builds all.
    """

    NEEDS = {"dim_date": [], "dim_city": [], "dim_host": [], "dim_property": [], "dim_neighbourhood": [], "dim_reviewer": [],
             "fact_listing_snapshot": ["dim_host", "dim_property", "dim_neighbourhood", "dim_city", "dim_date"],
             "fact_calendar": ["fact_listing_snapshot", "dim_city", "dim_date"],
             "fact_review": ["fact_listing_snapshot", "dim_reviewer", "dim_city", "dim_date"]}

    def __init__(self, spark: SparkSession, gold: DataFrame | None, calendar: DataFrame | None, reviews: DataFrame | None,
                 path: str | None = None, config: dict = settings.CITIES):
        if gold is None:
            raise FileNotFoundError("the enriched listings are required")
        for name, df in (("calendar", calendar), ("reviews", reviews)):
            if df is None:
                log.warning("%s missing: the fact table stays empty", name)
        self._spark, self._path, self._built = spark, path, {}
        self._locks = {name: Lock() for name in self.NEEDS}
        self._make = {
            "dim_date": lambda: dim_date(spark, gold, calendar, reviews), "dim_city": lambda: city_dimension(spark, cities=config),
            "dim_host": lambda: dim_host(gold), "dim_property": lambda: dim_property(gold),
            "dim_neighbourhood": lambda: dim_neighbourhood(gold), "dim_reviewer": lambda: dim_reviewer(spark, reviews),
            "fact_listing_snapshot": lambda *dims: fact_listing_snapshot(gold, *dims),
            "fact_calendar": lambda *tables: fact_calendar(spark, calendar, *tables, config, path is not None),
            "fact_review": lambda *tables: fact_review(spark, reviews, *tables)}

    def build(self, names: Iterable[str]) -> list[DataFrame]:
        names = list(names)
        if not names:
            return []
        with ThreadPoolExecutor(len(names)) as pool:
            return list(pool.map(self.__getitem__, names))

    def __getitem__(self, name: str) -> DataFrame:
        with self._locks[name]:
            if name not in self._built:
                df = self._make[name](*self.build(self.NEEDS[name]))
                by = list(CALENDAR_LAYOUT) if name == "fact_calendar" else None
                if self._path is not None:
                    df = self._spark.read.schema(df.schema).parquet(write_table(df, f"{self._path}/{name}", by)).select(*df.columns)
                self._built[name] = df
            return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in self.NEEDS

    def __iter__(self) -> Iterator[str]:
        return iter(self.NEEDS)

    def __len__(self) -> int:
        return len(self.NEEDS)

    def items(self) -> ItemsView:
        self.build(self.NEEDS)
        return super().items()


def build_star(spark: SparkSession, gold: DataFrame | None, calendar: DataFrame | None, reviews: DataFrame | None,
               path: str | None = None, config: dict = settings.CITIES) -> dict[str, DataFrame]:
    """All nine tables; with ``path`` each is written before the next one reads it."""
    return dict(StarTables(spark, gold, calendar, reviews, path, config).items())


def table_counts(star: Mapping[str, DataFrame]) -> DataFrame:
    return row_counts(star)
