"""Market queries over the star schema: overview, segmentation, pricing, supply, demand, interventions.

Each query takes the star tables and returns a DataFrame.  Dimension joins carry no broadcast hint: the
optimizer broadcasts a side when its measured size allows it.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import bands
from ..functions.rounding import ratio, rows, share, stable_round
from ..operators.joins import small_side
from ..operators.ordering import aggregate_with_medians

Star = dict[str, DataFrame]


def snapshot(star: Star, *dims: str, city_key: int | None = None) -> DataFrame:
    """Listing facts with the columns of the named dimensions (city, property, neighbourhood, host)."""
    out = star["fact_listing_snapshot"]
    if city_key is not None:
        out = out.filter(F.col("city_key") == city_key)
    for dim in dims:
        side = star[f"dim_{dim}"]
        clash = [c for c in side.columns if c in out.columns and c != f"{dim}_key"]
        out = out.join(side.drop(*clash), f"{dim}_key")
    return out


def row_bound(star: Star, fact: str = "fact_listing_snapshot") -> int:
    """Rows of a stored fact, from its file footers; lookups widen the fact and filters only shrink it."""
    return star[fact].count()


def _calendar(star: Star, with_listing: bool = False) -> DataFrame:
    out = star["fact_calendar"].join(star["dim_date"], "date_key")
    if with_listing:
        facts = star["fact_listing_snapshot"].select(
            "listing_key", "city_key", F.col("price_local").alias("listing_price"))
        out = out.join(facts, "listing_key").join(star["dim_city"].select("city_key", "display_name"), "city_key")
    return out


def market_overview(star: Star) -> DataFrame:
    src = snapshot(star, "city", "neighbourhood").select(
        F.col("display_name").alias("city"), F.col("neighbourhood_name").alias("neighbourhood"), "price_local",
        "occupancy_rate_pct", "estimated_monthly_revenue", "estimated_annual_revenue")
    keys = ["city", "neighbourhood"]
    out = aggregate_with_medians(src, keys, [
        rows().alias("listing_count"), stable_round(F.avg("price_local"), 2).alias("avg_price"),
        stable_round(F.avg("occupancy_rate_pct"), 1).alias("avg_occupancy_pct"),
        stable_round(F.avg("estimated_monthly_revenue"), 0).alias("avg_monthly_revenue"),
        stable_round(F.sum("estimated_annual_revenue"), 0).alias("total_annual_revenue")],
        {"median_price": "price_local"}, row_bound(star))
    return (out.withColumn("median_price", stable_round("median_price", 2))
            .orderBy("city", F.desc_nulls_last("avg_monthly_revenue"), "neighbourhood"))


def host_segmentation(star: Star) -> DataFrame:
    src = snapshot(star, "city").drop("is_professional_host").join(
        star["dim_host"].select("host_key", "host_id", "is_professional_host"), "host_key")
    out = src.groupBy(F.col("display_name").alias("city"),
                      bands.flag_label("is_professional_host", "Professional", "Individual").alias("host_type")).agg(
        F.count_distinct("host_id").alias("host_count"), rows().alias("listing_count"),
        stable_round(F.avg("price_local"), 2).alias("avg_price"),
        stable_round(F.avg("review_scores_rating"), 2).alias("avg_rating"),
        stable_round(F.avg("occupancy_rate_pct"), 1).alias("avg_occupancy_pct"),
        stable_round(F.avg("estimated_monthly_revenue"), 0).alias("avg_monthly_revenue"),
        stable_round(F.sum("estimated_annual_revenue"), 0).alias("total_annual_revenue"))
    return out.orderBy("city", "host_type")


def price_positioning(star: Star) -> DataFrame:
    src = snapshot(star, "city", "property").filter("price_vs_neighbourhood IS NOT NULL")
    return src.groupBy(F.col("display_name").alias("city"), "room_type",
                       bands.price_segment("price_vs_neighbourhood").alias("price_segment")).agg(
        rows().alias("listing_count"), stable_round(F.avg("price_local"), 2).alias("avg_price"),
        stable_round(F.avg("occupancy_rate_pct"), 1).alias("avg_occupancy_pct"),
        stable_round(F.avg("review_scores_rating"), 2).alias("avg_rating")
    ).orderBy("city", "room_type", "price_segment")


def _taken(flag: str = "is_available") -> Column:
    """Days not known to be available."""
    return ~F.coalesce(F.col(flag), F.lit(False))


def seasonal_patterns(star: Star) -> DataFrame:
    booked = F.count_if(_taken())
    return _calendar(star).groupBy("year", "month", "month_name").agg(
        rows().alias("total_days"), booked.alias("booked_days"), stable_round(ratio(booked, rows(), 100), 1).alias("occupancy_pct"),
        stable_round(F.avg("price_local"), 2).alias("avg_asking_price"),
        stable_round(F.avg(F.when(~F.col("is_available"), F.col("price_local"))), 2).alias("avg_booked_price")
    ).orderBy("year", "month")


def supply_analysis(star: Star, min_listings: int = 10) -> DataFrame:
    counts = snapshot(star, "city", "property").groupBy(
        F.col("display_name").alias("city"), "property_type", "room_type").agg(
        rows().alias("listing_count"), stable_round(F.avg("accommodates"), 1).alias("avg_capacity"),
        stable_round(F.avg("price_local"), 2).alias("avg_price"),
        stable_round(F.avg("availability_365"), 0).alias("avg_availability_365"))
    # the window runs over already grouped rows: one per city, property type and room type
    total = F.sum("listing_count").over(Window.partitionBy("city"))
    return (counts.withColumn("pct_of_city_supply", stable_round(ratio("listing_count", total, 100), 1))
            .filter(F.col("listing_count") >= min_listings)
            .orderBy("city", F.desc("listing_count"), "property_type", "room_type"))


def review_velocity(star: Star) -> DataFrame:
    """Monthly reviews; about half of the guests leave one, hence the doubled booking estimate."""
    src = star["fact_review"].join(star["dim_date"].withColumnRenamed("date_key", "review_date_key"), "review_date_key")
    return src.groupBy("year", "month", "month_name").agg(
        rows().alias("review_count"), (rows() * 2).alias("estimated_bookings"),
        F.count_distinct("listing_key").alias("listings_reviewed"),
        stable_round(F.avg("comment_length"), 0).alias("avg_comment_length")).orderBy("year", "month")


def regulatory_compliance(star: Star) -> DataFrame:
    licensed = F.count_if(F.coalesce(F.col("license") != "", F.lit(False)))
    return snapshot(star, "city", "property", "neighbourhood").groupBy(
        F.col("display_name").alias("city"), F.col("neighbourhood_name").alias("neighbourhood")).agg(
        rows().alias("total_listings"), licensed.alias("with_license"),
        stable_round(ratio(licensed, rows(), 100), 1).alias("license_pct")).orderBy("city", F.desc("license_pct"), "neighbourhood")


def cross_city_comparison(star: Star) -> DataFrame:
    src = snapshot(star, "city").withColumnRenamed("display_name", "city")
    keys = ["city", "currency_code"]
    active = F.count_if("is_active")
    out = aggregate_with_medians(src, keys, [
        rows().alias("listing_count"), stable_round(F.avg("price_local"), 2).alias("avg_price_local"),
        stable_round(F.avg("price_usd"), 2).alias("avg_price_usd"),
        stable_round(F.avg("occupancy_rate_pct"), 1).alias("avg_occupancy_pct"),
        stable_round(F.avg("estimated_monthly_revenue"), 0).alias("avg_monthly_rev_local"),
        stable_round(F.avg("review_scores_rating"), 2).alias("avg_rating"),
        stable_round(F.avg("number_of_reviews"), 1).alias("avg_review_count"),
        active.alias("active_listings"), stable_round(ratio(active, rows(), 100), 1).alias("active_pct")],
        {"median_price_usd": "price_usd"}, row_bound(star))
    return out.withColumn("median_price_usd", stable_round("median_price_usd", 2)).orderBy(F.desc("avg_price_usd"), "city")


def executive_kpis(star: Star, city_key: int | None = None) -> DataFrame:
    return snapshot(star, city_key=city_key).agg(
        rows().alias("total_listings"), F.avg("price_usd").alias("avg_daily_rate_usd"),
        F.avg("occupancy_rate_pct").alias("avg_occupancy_pct"),
        share(F.col("is_professional_host")).alias("professional_host_pct"))


def map_points(star: Star, city_key: int | None = None, limit: int = 50_000) -> DataFrame:
    return snapshot(star, "property", city_key=city_key).select("latitude", "longitude", "price_usd", "room_type").limit(limit)


def neighbourhood_metrics(star: Star, city_key: int | None = None, min_listings: int = 50, top: int = 20) -> DataFrame:
    src = snapshot(star, "neighbourhood", city_key=city_key)
    keys = ["neighbourhood_name"]
    out = aggregate_with_medians(
        src, keys, [rows().alias("listing_count"), F.avg("occupancy_rate_pct").alias("avg_occupancy_pct")],
        {"median_price_usd": "price_usd", "median_monthly_revenue": "estimated_monthly_revenue"}, row_bound(star))
    return (out.filter(F.col("listing_count") > min_listings)
            .orderBy(F.desc_nulls_last("median_price_usd"), "neighbourhood_name").limit(top))


def room_type_metrics(star: Star, city_key: int | None = None) -> DataFrame:
    src = snapshot(star, "property", city_key=city_key)
    return aggregate_with_medians(src, ["room_type"], [rows().alias("listing_count")],
        {"median_price_usd": "price_usd"}, row_bound(star)).orderBy(
        F.desc("listing_count"), "room_type")


def valuation_arbitrage(star: Star, city_key: int | None = None, min_rating: float = 4.8, min_reviews: int = 30,
                        top: int = 50) -> DataFrame:
    """Well rated, well reviewed listings priced below the market median."""
    market = aggregate_with_medians(snapshot(star, city_key=city_key), [], [], {"m": "price_usd"}, row_bound(star))
    good = snapshot(star, "property", "neighbourhood", city_key=city_key).filter(
        (F.col("review_scores_rating") >= min_rating) & (F.col("number_of_reviews") > min_reviews)
        & (F.col("price_usd") < market.scalar()))
    return good.select("listing_id", "name", "price_usd", "bedrooms",
                       stable_round(ratio("price_usd", F.nullif("bedrooms", F.lit(0))), 2).alias("price_per_bedroom"),
                       "review_scores_rating", "number_of_reviews", "estimated_monthly_revenue", "neighbourhood_name"
                       ).orderBy(F.desc_nulls_last("estimated_monthly_revenue"), "listing_id").limit(top)


def host_concentration(star: Star, city_key: int | None = None) -> DataFrame:
    src = snapshot(star, city_key=city_key).withColumn(
        "host_segment", bands.flag_label("is_professional_host", "Professional (2+)", "Casual (1)"))
    return aggregate_with_medians(src, ["host_segment"], [rows().alias("listing_count"), F.avg("occupancy_rate_pct").alias("avg_occupancy_pct")],
        {"median_price_usd": "price_usd", "median_revenue": "estimated_monthly_revenue"}, row_bound(star)).orderBy(F.desc("listing_count"))


def temporal_trends(star: Star, city_key: int | None = None) -> DataFrame:
    src = _calendar(star)
    if city_key is not None and "fact_city" in src.columns:
        src = src.filter(F.col("fact_city") == city_key)  # a partition of the stored fact
    elif city_key is not None:
        mine = star["fact_listing_snapshot"].filter(F.col("city_key") == city_key).select("listing_key")
        src = src.join(mine, "listing_key", "left_semi")
    return src.groupBy(F.col("full_date").alias("date")).agg(
        F.avg("price_usd").alias("avg_price"),
        (F.lit(100.0) - share(F.col("is_available"))).alias("booked_occupancy_rate")).orderBy("date")


def scored_listings(star: Star, city_key: int | None = None) -> DataFrame:
    """Listings with area averages, health score and first matching action.

    Area averages come from an aggregate joined back, so a large area is summed in parallel and never becomes
    one task as it would in a window over the area.
    """
    src = snapshot(star, "property", "neighbourhood", city_key=city_key).filter(
        "number_of_reviews > 10 AND price_usd > 10")
    area = src.groupBy("neighbourhood_name").agg(
        F.avg("price_usd").alias("hood_avg_price"), F.avg("occupancy_rate_pct").alias("hood_avg_occ"),
        F.avg("review_scores_rating").alias("hood_avg_rating"))
    return src.join(small_side(area), "neighbourhood_name").select(
        "listing_id", "name", "neighbourhood_name", "price_usd", "hood_avg_price", "hood_avg_occ", "hood_avg_rating",
        stable_round("review_scores_rating", 2).alias("rating"), stable_round("occupancy_rate_pct", 1).alias("occupancy_pct"),
        bands.health_score("price_usd", "hood_avg_price", "review_scores_rating", "occupancy_rate_pct").alias("health_score"),
        bands.priority_action("price_usd", "hood_avg_price", "review_scores_rating", "occupancy_rate_pct",
                              "number_of_reviews", "availability_365", "is_professional_host").alias("priority_action"))


def intervention_radar(star: Star, city_key: int | None = None, top: int = 300) -> DataFrame:
    return scored_listings(star, city_key).filter(F.col("priority_action") != bands.HEALTHY).select(
        "listing_id", "name", "neighbourhood_name", "price_usd", "rating", "occupancy_pct", "health_score",
        "priority_action").orderBy(F.asc_nulls_last("health_score"), "listing_id").limit(top)


def intervention_queue(star: Star, city_key: int | None = None, top: int = 300) -> DataFrame:
    return intervention_radar(star, city_key, top).groupBy("priority_action").agg(rows().alias("count")).orderBy(F.desc("count"))


def neighbourhood_interventions(star: Star, city_key: int | None = None, min_listings: int = 20) -> DataFrame:
    facts = snapshot(star, city_key=city_key)
    market = facts.agg(F.avg("price_usd"))
    areas = snapshot(star, "neighbourhood", city_key=city_key).groupBy("neighbourhood_name").agg(
        F.count("listing_id").alias("total_listings"), F.avg("price_usd").alias("p"),
        F.avg("occupancy_rate_pct").alias("o"), F.avg("review_scores_rating").alias("r"))
    return areas.filter(F.col("total_listings") > min_listings).select(
        "neighbourhood_name", "total_listings", stable_round("p", 0).alias("avg_price"),
        stable_round("o", 1).alias("avg_occupancy_pct"), stable_round("r", 2).alias("avg_rating"),
        bands.opportunity_zone("o", "p", "total_listings", "r", market.scalar()).alias("opportunity_zone")
    ).orderBy(F.desc_nulls_last("avg_occupancy_pct"), "neighbourhood_name")


def available_cities(star: Star) -> DataFrame:
    return star["dim_city"].select("city_key", "display_name").orderBy("display_name")


NAMED: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (
    market_overview, host_segmentation, price_positioning, seasonal_patterns, supply_analysis, review_velocity,
    regulatory_compliance, cross_city_comparison, executive_kpis, map_points, neighbourhood_metrics,
    room_type_metrics, valuation_arbitrage, host_concentration, temporal_trends, intervention_radar,
    intervention_queue, neighbourhood_interventions, available_cities)}
