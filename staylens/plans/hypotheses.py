"""The market hypotheses, composed from the statistical operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions.rounding import rows
from ..operators import stats as S
from ..operators.distribution import groups_with, rows_union, trim_at
from ..operators.ordering import checkpointed
from .explore import listing_base, weekend_pairs
from .market import Star

METRICS = ["price_usd", "review_scores_rating", "occupancy_rate_pct"]


def price_base(star: Star, price: str = "price_local") -> DataFrame:
    """Listings with a positive price up to its 99th percentile."""
    return trim_at(listing_base(star).filter(F.col(price) > 0), price, 0.99)


COLUMNS = ["listing_id", "city", "room_type", "neighbourhood_name", "neighbourhood_group", "host_is_superhost",
           "number_of_reviews", "price_local", *METRICS]


def stored_base(star: Star, price: str = "price_local") -> DataFrame:
    """The price base written once, because a family of tests reads it many times."""
    return checkpointed(price_base(star, price).select(*COLUMNS))


def area_column(df: DataFrame) -> str:
    """The area groups when there are at least three, else the areas themselves."""
    n = df.agg(F.count_distinct("neighbourhood_group")).first()[0]
    return "neighbourhood_group" if n >= 3 else "neighbourhood_name"


def hypothesis_tests(star: Star, cities: list[str] | None = None, min_group: int = 30) -> DataFrame:
    """Entire homes against private rooms, superhosts, review counts, areas per city, weekends."""
    base = stored_base(star)
    flagged = base.withColumn("_super", F.when(F.col("host_is_superhost"), "Superhost").when(~F.col("host_is_superhost"), "Regular")) \
        .withColumn("_reviews", F.when(F.col("number_of_reviews") > 10, ">10 reviews").otherwise("≤10 reviews"))
    parts = [
        S.two_group_test(base, "room_type", "price_local", "Entire home/apt", "Private room", "H1", "greater"),
        S.two_group_test(flagged, "_super", "review_scores_rating", "Superhost", "Regular", "H2", "greater"),
        S.two_group_test(flagged, "_reviews", "price_local", ">10 reviews", "≤10 reviews", "H3"),
        S.paired_test(weekend_pairs(star), "weekend_price", "weekday_price", "H5").drop("mean_difference"),
    ]
    for city in cities or [c["display_name"] for c in settings.CITIES.values()]:
        mine = base.filter(F.col("city") == city)
        area = area_column(mine)
        large = groups_with(mine, [area], min_group)
        if large.select(area).distinct().limit(3).count() == 3:
            parts.append(S.multi_group_test(large, area, "price_local", f"H4 ({city})", with_posthoc=False)["test"])
    return rows_union(parts)


def area_intervals(star: Star, resamples: int = 5_000, top: int = 10, min_group: int = 30, least: int = 3) -> DataFrame:
    """Bootstrap intervals of the mean price for the largest areas of each city.

    A city is divided by area group where it has at least ``least`` of them, else by neighbourhood; a city with fewer than
    ``least`` large enough areas is left out.
    """
    from pyspark.sql import Window
    base = price_base(star)
    groups = base.groupBy("city").agg(F.count_distinct("neighbourhood_group").alias("_groups"))
    named = (base.join(F.broadcast(groups), "city")  # one row per city
             .withColumn("area", F.when(F.col("_groups") >= least, F.col("neighbourhood_group")).otherwise(F.col("neighbourhood_name"))))
    sizes = named.filter("area IS NOT NULL").groupBy("city", "area").agg(rows().alias("_n")).filter(F.col("_n") >= min_group)
    w = Window.partitionBy("city").orderBy(F.desc("_n"), "area")
    ranked = sizes.withColumn("_r", F.row_number().over(w)).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("city")))
    largest = ranked.filter((F.col("_r") <= top) & (F.col("_k") >= least)).select("city", "area")
    return S.bootstrap_mean(named.join(largest, ["city", "area"], "left_semi"), ["city", "area"], "price_local", "listing_id", resamples)


def room_intervals(star: Star, resamples: int = 10_000, min_group: int = 30) -> DataFrame:
    base = groups_with(price_base(star), ["room_type"], min_group)
    return S.bootstrap_mean(base, ["room_type"], "price_local", "listing_id", resamples)


def city_tests(star: Star) -> DataFrame:
    """Omnibus tests of price, rating and occupancy across cities, room mix, and price pairs, Holm-corrected."""
    base = stored_base(star, "price_usd")
    results = {m: S.multi_group_test(base, "city", m, f"MC-{m}") for m in METRICS}
    tests = [r["test"].select(F.concat("hypothesis", F.lit(" (omnibus)")).alias("test"), "p_value") for r in results.values()]
    mix = S.with_chi2_tail(S.chi_square(base, "city", "room_type"), F.col("df"))
    tests.append(mix.select(F.lit("Chi² (room type × city)").alias("test"), "p_value"))
    if "posthoc" in results["price_usd"]:
        tests.append(results["price_usd"]["posthoc"].select(
            F.concat_ws(" ", F.lit("Price:"), "group_a", F.lit("vs"), "group_b").alias("test"), "p_value"))
    return S.adjust_p(rows_union(tests))


def city_effects(star: Star) -> DataFrame:
    return S.pairwise_effects(price_base(star, "price_usd"), "city", METRICS)
