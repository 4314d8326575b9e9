"""Exploration queries over the star schema: distributions, seasons, tenure, portfolios, reviews."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions import bands
from ..functions.rounding import ratio, rows, share, stable_round
from ..operators import distribution as D
from ..operators.ordering import aggregate_with_medians, exact_quantiles, join_groups
from .market import Star, _calendar, row_bound, snapshot

MONTHS = list(range(1, 13))
WINDOWS = ["availability_30", "availability_60", "availability_90", "availability_365"]


def listing_base(star: Star) -> DataFrame:
    """Listing facts with the attributes of four dimensions, one row per listing."""
    hosts = star["dim_host"].select("host_key", "host_id", "host_is_superhost", "host_response_rate", "host_listings_count")
    props = star["dim_property"].select("property_key", F.col("name").alias("listing_name"), "property_type", "room_type",
                                        "accommodates", "bedrooms", "beds", "bathrooms", "amenity_count")
    areas = star["dim_neighbourhood"].select("neighbourhood_key", "neighbourhood_name", "neighbourhood_group")
    cities = star["dim_city"].select("city_key", F.col("display_name").alias("city"))
    return (star["fact_listing_snapshot"].join(cities, "city_key").join(props, "property_key")
            .join(areas, "neighbourhood_key").join(hosts, "host_key"))


def monthly_availability(star: Star) -> DataFrame:
    cal = _calendar(star, with_listing=True)
    free = F.col("is_available")
    return cal.groupBy(F.col("display_name").alias("city")).agg(*[
        stable_round(ratio(F.count_if(free & (F.col("month") == m)), F.count_if(F.col("month") == m), 100), 1)
        .alias(f"month_{m}") for m in MONTHS]).orderBy("city")


def _priced_calendar(star: Star) -> DataFrame:
    """Calendar days with a positive price, the listing's price standing in where the day has none."""
    return (_calendar(star, with_listing=True)
            .withColumn("price", F.coalesce("price_local", "listing_price")).filter("price > 0")
            .withColumnRenamed("display_name", "city"))


def monthly_pricing(star: Star) -> DataFrame:
    taken = ~F.col("is_available")
    return _priced_calendar(star).groupBy("city", "year", "month", "month_name").agg(
        stable_round(F.avg("price"), 2).alias("avg_asking_price"),
        stable_round(F.avg(F.when(taken, F.col("price"))), 2).alias("avg_booked_price"),
        stable_round(share(taken), 1).alias("occupancy_pct"),
        F.count_distinct("listing_key").alias("listings_active")).orderBy("city", "year", "month")


def weekday_pricing(star: Star) -> DataFrame:
    src, keys = _priced_calendar(star), ["city", "is_weekend", "day_name", "day_of_week"]
    out = aggregate_with_medians(src, keys, [stable_round(F.avg("price"), 2).alias("avg_price"), rows().alias("observations")],
        {"median_price": "price"}, row_bound(star, "fact_calendar"))
    return out.withColumn("median_price", stable_round("median_price", 2)).orderBy("city", "day_of_week").drop("day_of_week")


def _dated_reviews(star: Star) -> DataFrame:
    facts = star["fact_listing_snapshot"].select("listing_key", "city_key")
    return (star["fact_review"].join(star["dim_date"].withColumnRenamed("date_key", "review_date_key"), "review_date_key")
            .join(facts, "listing_key").join(star["dim_city"].select("city_key", F.col("display_name").alias("city")), "city_key"))


def city_review_velocity(star: Star, since: int = 2015) -> DataFrame:
    return _dated_reviews(star).filter(F.col("year") >= since).groupBy("city", "year", "month", "month_name").agg(
        rows().alias("review_count"), (rows() * 2).alias("estimated_bookings"),
        F.count_distinct("listing_key").alias("listings_reviewed")).withColumn(
        "period", bands.month_start("year", "month")).orderBy("city", "year", "month")


def review_growth(star: Star, since: int = 2015) -> DataFrame:
    src = _dated_reviews(star).filter(F.col("year") >= since)
    return D.growth(src, ["city"], "year", rows()).withColumnRenamed("total", "review_count").filter(
        "growth_pct IS NOT NULL").orderBy("city", "year")


def tenure_distribution(star: Star, max_price: float = 1000) -> DataFrame:
    src = snapshot(star, "city").filter(
        F.col("host_tenure_years").isNotNull() & (F.col("price_local") > 0) & (F.col("price_local") < max_price)).select(
        F.col("display_name").alias("city"), bands.tenure_band("host_tenure_years").alias("tenure_band"),
        "price_local", "review_scores_rating", "occupancy_rate_pct")
    return D.five_numbers(src, ["city", "tenure_band"], ["price_local", "review_scores_rating", "occupancy_rate_pct"])


def minimum_nights_grid(star: Star, low: int = 0, high: int = 365) -> DataFrame:
    src = _calendar(star, with_listing=True).withColumnRenamed("display_name", "city").filter(
        (F.col("minimum_nights") > low) & (F.col("minimum_nights") < high))
    keys = ["city", "month", "month_name", "day_name", "day_of_week"]
    out = aggregate_with_medians(src, keys, [stable_round(F.avg("minimum_nights"), 1).alias("avg_min_nights")],
        {"median_min_nights": "minimum_nights"}, row_bound(star, "fact_calendar"))
    return out.withColumn("median_min_nights", stable_round("median_min_nights", 1)).orderBy("city", "month", "day_of_week")


def minimum_nights_by_month(star: Star) -> DataFrame:
    """Weekday rows, month columns."""
    grid = minimum_nights_grid(star)
    return D.pivot_values(grid, ["city", "day_name"], "month", MONTHS,
                          lambda c: F.avg(F.when(c, F.col("avg_min_nights"))), "month_")


def _portfolios(star: Star) -> DataFrame:
    return listing_base(star).withColumn("host_segment", bands.portfolio_segment("host_listings_count"))


def hosts_per_city(star: Star) -> DataFrame:
    """One row per host and city."""
    return _portfolios(star).groupBy("city", "host_id").agg(
        F.max("host_listings_count").alias("host_listings_count"), F.max("host_segment").alias("host_segment"))


def portfolio_hosts(star: Star, cities: list[str] | None = None) -> DataFrame:
    """Hosts per segment, one column per city."""
    names = cities or [c["display_name"] for c in settings.CITIES.values()]
    return D.crosstab(hosts_per_city(star), "host_segment", "city", names)


def portfolio_performance(star: Star) -> DataFrame:
    src, keys = _portfolios(star), ["city", "host_segment"]
    out = aggregate_with_medians(src, keys, [
        F.count("listing_id").alias("listings"), stable_round(F.avg("price_local"), 2).alias("avg_price"),
        stable_round(F.avg("review_scores_rating"), 2).alias("avg_rating"),
        stable_round(F.avg("occupancy_rate_pct"), 2).alias("avg_occupancy"),
        stable_round(F.avg("estimated_monthly_revenue"), 2).alias("avg_monthly_rev")],
        {"median_price": "price_local"}, row_bound(star))
    rank = F.lit(len(bands.SEGMENT_ORDER))
    for i, label in enumerate(bands.SEGMENT_ORDER):
        rank = F.when(F.col("host_segment") == label, i).otherwise(rank)
    return out.withColumn("median_price", stable_round("median_price", 2)).orderBy("city", rank)


def superhost_premium(star: Star) -> DataFrame:
    return listing_base(star).filter("host_is_superhost IS NOT NULL").groupBy(
        "city", bands.yes_no_label("host_is_superhost", "Superhost", "Regular").alias("host_type")).agg(
        F.count("listing_id").alias("listings"), stable_round(F.avg("price_local"), 2).alias("avg_price"),
        stable_round(F.avg("review_scores_rating"), 2).alias("avg_rating"),
        stable_round(F.avg("occupancy_rate_pct"), 2).alias("avg_occupancy"),
        stable_round(F.avg("estimated_monthly_revenue"), 2).alias("avg_monthly_rev")).orderBy("city", "host_type")


def supply_concentration(star: Star, percents: list[int] = [1, 5, 10, 20, 50]) -> DataFrame:
    return D.top_shares(hosts_per_city(star), ["city"], "host_listings_count", percents)


def supply_inequality(star: Star) -> DataFrame:
    return D.gini(hosts_per_city(star), ["city"], "host_listings_count")


def rating_by_review_bin(star: Star) -> DataFrame:
    src = listing_base(star).filter("number_of_reviews > 0 AND review_scores_rating IS NOT NULL").withColumn(
        "review_bin", bands.review_bin("number_of_reviews"))
    return D.five_numbers(src, ["city", "review_bin"], ["review_scores_rating"])


def busy_listings(star: Star, min_reviews: int = 50, cut: float = 4.0) -> DataFrame:
    """Much reviewed listings: badly rated ones against the others."""
    src = listing_base(star).filter((F.col("number_of_reviews") >= min_reviews) & F.col("review_scores_rating").isNotNull())
    src = src.withColumn("score_group", F.when(F.col("review_scores_rating") < cut, "low").otherwise("normal"))
    keys = ["score_group"]
    out = aggregate_with_medians(src, keys, [rows().alias("listings"), F.avg("price_local").alias("avg_price"),
                                 F.avg("occupancy_rate_pct").alias("avg_occupancy"),
                                 F.avg("reviews_per_month").alias("avg_reviews_per_month")],
        {"median_price": "price_local"}, row_bound(star))
    return join_groups(out, D.modes(src, keys, "room_type", "top_room_type"), keys)


def busy_low_rated(star: Star, min_reviews: int = 50, cut: float = 4.0) -> DataFrame:
    return listing_base(star).filter((F.col("number_of_reviews") >= min_reviews) & (F.col("review_scores_rating") < cut)).select(
        "listing_id", "city", "listing_name", "room_type", "neighbourhood_name", "price_local", "number_of_reviews",
        "review_scores_rating").orderBy(F.desc("number_of_reviews"), "listing_id")


def sub_score_profile(star: Star) -> DataFrame:
    """Mean sub-scores per city over listings that have all of them."""
    src = listing_base(star).dropna(subset=settings.SUB_SCORES)
    return src.groupBy("city").agg(*[stable_round(F.avg(c), 3).alias(c) for c in settings.SUB_SCORES],
                                   stable_round(F.avg("review_scores_rating"), 3).alias("overall")).orderBy("city")


def sub_score_variance(star: Star) -> DataFrame:
    return D.variances(listing_base(star), settings.SUB_SCORES).orderBy(F.desc("variance"))


def room_price_summary(star: Star) -> DataFrame:
    src = D.trim_at(listing_base(star).filter("price_local > 0"), "price_local", 0.99)
    keys = ["city", "room_type"]
    out = aggregate_with_medians(src, keys, [F.count("price_local").alias("count"), stable_round(F.avg("price_local"), 2).alias("mean"),
                                 stable_round(F.stddev_samp("price_local"), 2).alias("std")],
        {"median": "price_local"}, row_bound(star))
    return out.withColumn("median", stable_round("median", 2)).orderBy(*keys)


def market_structure(star: Star) -> DataFrame:
    """Shares and medians per city over prices up to the 99th percentile."""
    src = D.trim_at(listing_base(star).filter("price_usd > 0"), "price_usd", 0.99)
    out = aggregate_with_medians(src, ["city"], [
        F.count("listing_id").alias("total_listings"),
        stable_round(share(F.col("room_type") == "Entire home/apt"), 2).alias("pct_entire_home"),
        stable_round(share(F.col("host_is_superhost")), 2).alias("pct_superhost"),
        stable_round(share(F.col("is_professional_host")), 2).alias("pct_professional")],
        {"median_price_usd": "price_usd", "median_rating": "review_scores_rating",
         "median_occupancy": "occupancy_rate_pct", "median_reviews_per_month": "reviews_per_month"}, row_bound(star))
    return out.withColumns({c: stable_round(c, 2) for c in out.columns if c.startswith("median_")}).orderBy("city")


def room_mix(star: Star) -> DataFrame:
    src = D.trim_at(listing_base(star).filter("price_usd > 0"), "price_usd", 0.99)
    return D.row_percent(D.crosstab(src, "city", "room_type", settings.ROOM_TYPES), "city")


def availability_windows(star: Star) -> DataFrame:
    """Mean available days, windows as rows, cities as columns."""
    cities = [c["display_name"] for c in settings.CITIES.values()]
    long = D.unpivot(listing_base(star), ["city"], WINDOWS, "window", "days")
    return D.pivot_values(long, ["window"], "city", cities, lambda c: F.avg(F.when(c, F.col("days"))))


def occupancy_boxes(star: Star) -> DataFrame:
    return D.five_numbers(listing_base(star), ["city"], ["occupancy_rate_pct"])


def professional_comparison(star: Star) -> DataFrame:
    """Prices up to the 95th percentile, occupancy and rating, with their spread."""
    src = listing_base(star).filter("is_professional_host IS NOT NULL").withColumn(
        "host_type", bands.yes_no_label("is_professional_host", "Professional", "Individual"))
    cap = exact_quantiles(src, [], {"cap": ("price_local", 0.95)}).scalar()
    price = F.when(F.col("price_local") <= cap, F.col("price_local"))
    return src.withColumn("capped_price", price).groupBy("city", "host_type").agg(
        F.count("capped_price").alias("priced_listings"), F.avg("capped_price").alias("avg_price"),
        F.stddev_samp("capped_price").alias("std_price"),
        F.avg("occupancy_rate_pct").alias("avg_occupancy"), F.stddev_samp("occupancy_rate_pct").alias("std_occupancy"),
        F.avg("review_scores_rating").alias("avg_rating"), F.stddev_samp("review_scores_rating").alias("std_rating"))


def review_count_histogram(star: Star, log: bool = False, bins: int | None = None, clip: int = 300) -> DataFrame:
    src = listing_base(star).filter("number_of_reviews > 0")
    if log:
        return D.log_histogram(src, "number_of_reviews", bins or 40, ["city"])
    return D.histogram(src, "number_of_reviews", bins or 50, ["city"], upper=clip)


def portfolio_histogram(star: Star, log: bool = False, bins: int | None = None, clip: int = 50) -> DataFrame:
    hosts = hosts_per_city(star)
    if log:
        return D.log_histogram(hosts, "host_listings_count", bins or 30, ["city"])
    return D.histogram(hosts, "host_listings_count", bins or 50, ["city"], upper=clip)


def rating_shares(star: Star) -> DataFrame:
    rated = listing_base(star).filter("review_scores_rating IS NOT NULL")
    return aggregate_with_medians(rated, [], [rows().alias("rated"), share(F.col("review_scores_rating") >= 4.0).alias("pct_4_0"),
                    share(F.col("review_scores_rating") >= 4.5).alias("pct_4_5")],
        {"median_rating": "review_scores_rating"}, row_bound(star))


def demand_correlation(star: Star) -> DataFrame:
    return listing_base(star).groupBy("city").agg(F.corr("reviews_per_month", "occupancy_rate_pct").alias("correlation"))


def top_areas_by_median(star: Star, top: int = 15) -> DataFrame:
    """Areas with the highest median price per city."""
    from pyspark.sql import Window
    meds = aggregate_with_medians(listing_base(star), ["city", "neighbourhood_name"], [], {"median_price": "price_local"}, row_bound(star))
    w = Window.partitionBy("city").orderBy(F.desc("median_price"), "neighbourhood_name")
    return meds.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def weekend_pairs(star: Star) -> DataFrame:
    """Mean weekend and weekday price of each listing that has both."""
    return (star["fact_calendar"].filter("price_local > 0").join(star["dim_date"].select("date_key", "is_weekend"), "date_key")
            .groupBy("listing_key").agg(F.avg(F.when(F.col("is_weekend"), F.col("price_local"))).alias("weekend_price"),
                                        F.avg(F.when(~F.col("is_weekend"), F.col("price_local"))).alias("weekday_price"))
            .filter("weekend_price IS NOT NULL AND weekday_price IS NOT NULL"))


NAMED: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (
    listing_base, monthly_availability, monthly_pricing, weekday_pricing, city_review_velocity, review_growth,
    tenure_distribution, minimum_nights_grid, minimum_nights_by_month, portfolio_hosts, portfolio_performance,
    superhost_premium, supply_concentration, supply_inequality, rating_by_review_bin, busy_listings, busy_low_rated,
    sub_score_profile, sub_score_variance, room_price_summary, market_structure, room_mix, availability_windows,
    occupancy_boxes, professional_comparison, review_count_histogram, portfolio_histogram, rating_shares,
    demand_correlation, top_areas_by_median, weekend_pairs)}
