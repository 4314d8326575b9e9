"""Registered queries: silver, gold and star layers."""

from pyspark.sql import functions as F

from staylens.functions.rounding import stable_round
from staylens.operators import cleaning, enrich, star
from staylens.plans.warehouse import warehouse
from staylens.sources.sinks import rejected_rows, valid_rows

from . import testbed
from .oracle_base import R, statement

ENTRIES: dict[str, tuple] = {}


def wh(spark, sf_dir):
    return warehouse(spark, sf_dir, lambda: {k: testbed.raw_table(spark, sf_dir, k) for k in testbed.SOURCES})


def add(name, build, sql=None, extra=None):
    ENTRIES[name] = (build, statement(sql, extra) if sql else None)


def fixed(df, digits=4):
    """Double columns cut to ``digits`` places for comparison."""
    return df.select(*[stable_round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double"
                       else F.col(f.name) for f in df.schema.fields])


def _fix_sql(columns, doubles, digits=4):
    return ", ".join(f"{R(c, digits)} AS {c}" if c in doubles else c for c in columns)


SILVER = ["city", "id", "name", "host_id", "host_name", "host_since", "host_response_rate", "host_is_superhost",
          "neighbourhood_cleansed", "neighbourhood_group_cleansed", "latitude", "property_type", "room_type",
          "accommodates", "bathrooms", "bathrooms_shared", "bedrooms", "beds", "amenity_count",
          "host_verification_count", "price", "review_scores_value", "last_review", "instant_bookable"]
SILVER_D = {"host_response_rate", "latitude", "bathrooms", "bedrooms", "beds", "price", "review_scores_value"}
add("clean_listings",
    lambda s, d: fixed(cleaning.clean_listings(wh(s, d).raw["listings"], ["city"]).select(
        *SILVER, "_bedrooms_imputed", "_validation_flags", "_is_valid")),
    f"SELECT {_fix_sql(SILVER, SILVER_D)}, bedrooms_imputed AS _bedrooms_imputed, flags AS _validation_flags, "
    "flags = '' AS _is_valid FROM flagged_listings")
add("clean_calendar",
    lambda s, d: fixed(cleaning.clean_calendar(wh(s, d).raw["calendar"]).groupBy(
        "city", "date", "available", "_validation_flags", "_is_valid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"), F.sum("adjusted_price").alias("adjusted_price"),
        F.sum("listing_id").alias("listing_ids"), F.sum("minimum_nights").alias("nights")), 2),
    f"SELECT city, date, available, flags AS _validation_flags, flags = '' AS _is_valid, count(*) AS n, "
    f"{R('sum(price)', 2)} AS price, {R('sum(adjusted_price)', 2)} AS adjusted_price, sum(listing_id)::BIGINT AS listing_ids, "
    "sum(minimum_nights)::BIGINT AS nights FROM flagged_calendar GROUP BY ALL")
add("clean_reviews",
    lambda s, d: cleaning.clean_reviews(wh(s, d).raw["reviews"]),
    "SELECT * EXCLUDE (flags), flags AS _validation_flags, flags = '' AS _is_valid FROM flagged_reviews")
add("clean_neighbourhoods",
    lambda s, d: cleaning.clean_neighbourhoods(wh(s, d).raw["neighbourhoods"]),
    "SELECT * EXCLUDE (flags), flags AS _validation_flags, flags = '' AS _is_valid FROM flagged_neighbourhoods")
_ALL = " UNION ALL ".join(f"SELECT '{k}' AS file_type, flags FROM flagged_{k}"
                          for k in ("neighbourhoods", "listings", "calendar", "reviews"))
add("clean_all",
    lambda s, d: cleaning.cleaning_summary(cleaning.clean_all(wh(s, d).raw, ["city"])),
    "SELECT file_type, count(*) input_rows, count(*) FILTER (flags = '') output_rows, count(*) FILTER (flags <> '') "
    f"rejected_rows, {R('count(*) FILTER (flags <> $$$$) * 100e0 / count(*)'.replace('$$$$', chr(39) * 2), 2)} AS rejection_pct "
    f"FROM ({_ALL}) GROUP BY file_type")
add("cleaning_totals",
    lambda s, d: cleaning.cleaning_summary(wh(s, d).flagged, ["city"]),
    "SELECT file_type, city, count(*) input_rows, count(*) FILTER (flags = '') output_rows, count(*) FILTER (flags <> '') "
    f"rejected_rows, {R('count(*) FILTER (length(flags) > 0) * 100e0 / count(*)', 2)} AS rejection_pct FROM ("
    + _ALL.replace("flags FROM", "city, flags FROM") + ") GROUP BY file_type, city")
add("keep_valid_rows",
    lambda s, d: valid_rows(wh(s, d).flagged["listings"]).select("city", "id", "price", "room_type"),
    "SELECT city, id, price, room_type FROM s_listings")
add("keep_rejected_rows",
    lambda s, d: rejected_rows(wh(s, d).flagged["listings"]).select("city", "id", "price", "room_type", "_validation_flags"),
    "SELECT city, id, price, room_type, flags AS _validation_flags FROM flagged_listings WHERE flags <> ''")

CAL = ["city", "listing_id", "total_days", "days_available", "days_booked", "avg_asking_price", "median_asking_price",
       "estimated_annual_revenue", "avg_booked_price", "avg_adjusted_asking_price", "avg_min_nights_cal",
       "avg_max_nights_cal", "occupancy_rate_pct", "estimated_monthly_revenue"]
CAL_D = set(CAL[5:])
add("calendar_by_listing",
    lambda s, d: fixed(enrich.calendar_by_listing(wh(s, d).silver["calendar"], ["city", "listing_id"])),
    f"SELECT {_fix_sql(CAL, CAL_D)} FROM cal_agg")
REV = ["city", "listing_id", "review_count_computed", "first_review_date_computed", "last_review_date_computed",
       "unique_reviewers", "avg_comment_length", "median_comment_length"]
add("reviews_by_listing",
    lambda s, d: fixed(enrich.reviews_by_listing(wh(s, d).silver["reviews"], ["city", "listing_id"])),
    f"SELECT {_fix_sql(REV, set(REV[6:]))} FROM rev_agg")
AREA = ["city", "neighbourhood_cleansed", "neighbourhood_listing_count", "neighbourhood_median_price",
        "neighbourhood_mean_price", "neighbourhood_avg_rating", "neighbourhood_avg_availability", "neighbourhood_group"]
add("area_benchmarks",
    lambda s, d: fixed(enrich.area_benchmarks(
        wh(s, d).silver["listings"], enrich.neighbourhood_reference(wh(s, d).silver["neighbourhoods"], ["city"]), ["city"])),
    f"SELECT {_fix_sql(AREA, set(AREA[3:7]))} FROM area_agg")
GOLD_D = {"price_local", "host_tenure_years", "review_frequency_monthly", "price_per_bedroom", "price_per_person",
          "price_vs_neighbourhood", "price_usd", "avg_asking_price_usd", "median_asking_price_usd",
          "avg_booked_price_usd", "estimated_monthly_revenue_usd", "estimated_annual_revenue_usd",
          "neighbourhood_median_price_usd", "neighbourhood_mean_price_usd", "bedrooms", "latitude", *CAL_D,
          *AREA[3:7], *REV[6:]}
GOLD = ["city", "id", "host_id", "room_type", "neighbourhood_cleansed", "scrape_date", "city_display_name",
        "currency_code", "is_active", "is_professional_host", "total_days", "days_booked", "review_count_computed",
        "unique_reviewers", "neighbourhood_listing_count", "neighbourhood_group", *sorted(GOLD_D)]
add("enrich",
    lambda s, d: fixed(enrich.enrich(*[wh(s, d).silver[k] for k in ("listings", "calendar", "reviews", "neighbourhoods")])
                       .select(*GOLD)),
    f"SELECT {_fix_sql(GOLD, GOLD_D)} FROM gold")
add("join_coverage",
    lambda s, d: enrich.join_coverage(wh(s, d).gold, ["city"]),
    f"SELECT city, count(*) listings_count, {R('count(total_days) * 100e0 / count(*)', 1)} AS calendar_coverage_pct, "
    f"{R('count(review_count_computed) * 100e0 / count(*)', 1)} AS reviews_coverage_pct, "
    f"{R('count(neighbourhood_listing_count) * 100e0 / count(*)', 1)} AS neighbourhood_coverage_pct FROM gold GROUP BY city")

add("dim_date", lambda s, d: star.dim_date(s, wh(s, d).gold, wh(s, d).silver["calendar"], wh(s, d).silver["reviews"]),
    "SELECT * FROM dim_date")
add("dim_city", lambda s, d: wh(s, d).star["dim_city"].join(
        wh(s, d).gold.groupBy(F.col("city").alias("city_name")).agg(F.count(F.lit(1)).alias("listings")), "city_name"),
    "SELECT c.*, n.listings FROM dim_city c JOIN (SELECT city city_name, count(*) listings FROM gold GROUP BY city) n USING (city_name)")
add("dim_host", lambda s, d: fixed(star.dim_host(wh(s, d).gold)),
    "SELECT * REPLACE (" + ", ".join(f"{R(c, 4)} AS {c}" for c in ("host_response_rate", "host_acceptance_rate", "host_tenure_years"))
    + ") FROM dim_host")
add("dim_property", lambda s, d: fixed(star.dim_property(wh(s, d).gold)),
    f"SELECT * REPLACE ({R('bathrooms', 4)} AS bathrooms) FROM dim_property")
add("dim_neighbourhood", lambda s, d: fixed(star.dim_neighbourhood(wh(s, d).gold)),
    "SELECT * REPLACE (" + ", ".join(f"{R(c, 4)} AS {c}" for c in ("median_price", "mean_price", "avg_rating", "avg_availability"))
    + ") FROM dim_neighbourhood")
add("dim_reviewer", lambda s, d: star.dim_reviewer(s, wh(s, d).silver["reviews"]), "SELECT * FROM dim_reviewer")
FACT_D = ["price_local", *star.FACT_DOUBLES, *star.FACT_SCORES, *star.FACT_MONEY]


def _star(s, d):
    w = wh(s, d)
    return w, w.star


add("fact_listing_snapshot",
    lambda s, d: fixed(star.fact_listing_snapshot(wh(s, d).gold, *[wh(s, d).star[k] for k in (
        "dim_host", "dim_property", "dim_neighbourhood", "dim_city", "dim_date")])),
    "SELECT * REPLACE (" + ", ".join(f"{R(c, 4)} AS {c}" for c in FACT_D) + ") FROM fact_listing_snapshot")
add("fact_calendar",
    lambda s, d: fixed(star.fact_calendar(s, wh(s, d).silver["calendar"], *[wh(s, d).star[k] for k in (
        "fact_listing_snapshot", "dim_city", "dim_date")])),
    "SELECT * REPLACE (" + ", ".join(f"{R(c, 4)} AS {c}" for c in ("price_local", "price_usd", "adjusted_price"))
    + ") FROM fact_calendar")
add("fact_review",
    lambda s, d: star.fact_review(s, wh(s, d).silver["reviews"], *[wh(s, d).star[k] for k in (
        "fact_listing_snapshot", "dim_reviewer", "dim_city", "dim_date")]),
    "SELECT * FROM fact_review")
_STAR = ["dim_date", "dim_city", "dim_host", "dim_property", "dim_neighbourhood", "dim_reviewer",
         "fact_listing_snapshot", "fact_calendar", "fact_review"]
add("build_star", lambda s, d: star.table_counts(wh(s, d).star),
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _STAR))
