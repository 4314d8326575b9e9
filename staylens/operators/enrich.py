"""One row per listing: calendar, review and area aggregates, derived measures, USD values, unification."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings
from ..functions.parsing import first_present
from ..functions.rounding import ratio, stable_round
from ..sources.readers import city_context

AREA_NAMES = ["neighbourhood_cleansed", "neighbourhood_name", "neighbourhood"]
USD_COLUMNS = ["price_local", "avg_asking_price", "median_asking_price", "avg_booked_price",
               "estimated_monthly_revenue", "estimated_annual_revenue", "neighbourhood_median_price",
               "neighbourhood_mean_price"]


def listing_key(df: DataFrame) -> str:
    name = first_present(df, ["listing_id", "id"])
    if name is None:
        raise ValueError("listings need a listing_id or id column")
    return name


def price_column(df: DataFrame) -> str | None:
    return first_present(df, ["price_local", "price"])


def _require(df: DataFrame, names: list[str], what: str) -> None:
    lacking = sorted(set(names) - set(df.columns))
    if lacking:
        raise ValueError(f"{what} lacks columns {lacking}")


def calendar_by_listing(calendar: DataFrame, keys: list[str] = ["listing_id"]) -> DataFrame:
    """Days, availability, prices and revenue per listing.

    A day that is not available is either booked or blocked, so occupancy and revenue are upper bounds.
    """
    _require(calendar, [*keys, "available"], "calendar")
    free, taken = F.col("available"), ~F.col("available")
    aggs = {"total_days": F.count(F.lit(1)),
            "days_available": F.coalesce(F.sum(free.cast("long")), F.lit(0)),
            "days_booked": F.coalesce(F.sum(taken.cast("long")), F.lit(0))}
    price = price_column(calendar)
    if price:
        aggs["avg_asking_price"] = F.avg(F.when(free, F.col(price)))
        # the sum over no rows is 0
        aggs["estimated_annual_revenue"] = F.coalesce(F.sum(F.when(taken, F.col(price))), F.lit(0.0))
        aggs["avg_booked_price"] = F.avg(F.when(taken, F.col(price)))
        aggs["median_asking_price"] = _median(F.when(free, F.col(price)))
    adjusted = first_present(calendar, ["adjusted_price", "adjusted_price_local"])
    if adjusted:
        aggs["avg_adjusted_asking_price"] = F.avg(F.when(free, F.col(adjusted)))
    for side in ("minimum", "maximum"):
        if f"{side}_nights" in calendar.columns:
            aggs[f"avg_{side[:3]}_nights_cal"] = F.avg(f"{side}_nights")
    out = calendar.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    out = out.withColumn("occupancy_rate_pct", stable_round(ratio("days_booked", "total_days", 100), 2))
    if price:
        out = out.withColumn("estimated_monthly_revenue", monthly_revenue("avg_booked_price"))
    return out


def monthly_revenue(price: str) -> Column:
    return stable_round(F.col("occupancy_rate_pct") / 100.0 * F.col(price) * 30, 2)


def _median(value: Column) -> Column:
    """Exact median in the same aggregate as the other measures; its state is the distinct values (prices, lengths) of a group."""
    return F.percentile(value.cast("double"), 0.5)


def reviews_by_listing(reviews: DataFrame, keys: list[str] = ["listing_id"]) -> DataFrame:
    """Review count, first and last date, reviewers, comment lengths per listing."""
    _require(reviews, [*keys, "date"], "reviews")
    aggs = {"review_count_computed": F.count(F.lit(1)), "first_review_date_computed": F.min("date"),
            "last_review_date_computed": F.max("date")}
    if "reviewer_id" in reviews.columns:
        # an unknown reviewer counts as one more reviewer
        aggs["unique_reviewers"] = F.count_distinct("reviewer_id") + F.max(F.col("reviewer_id").isNull().cast("long"))
    if "comments" in reviews.columns:
        aggs["avg_comment_length"] = stable_round(F.avg(F.length("comments")), 0)
        aggs["median_comment_length"] = _median(F.length("comments"))
    return reviews.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def neighbourhood_reference(neighbourhoods: DataFrame, within: list[str] = []) -> DataFrame | None:
    name = first_present(neighbourhoods, ["neighbourhood", "neighborhood", "neighbourhood_name"])
    if name is None:
        return None
    group = first_present(neighbourhoods, ["neighbourhood_group", "neighborhood_group"])
    cols = [*within, F.col(name).alias("neighbourhood_name")]
    return neighbourhoods.select(*cols, *([F.col(group).alias("neighbourhood_group")] if group else [])).distinct()


def area_benchmarks(listings: DataFrame, reference: DataFrame | None = None, within: list[str] = []) -> DataFrame | None:
    """Listing count, prices, rating and availability per area, with the area's reference attributes."""
    area = first_present(listings, AREA_NAMES)
    if area is None:
        return None
    src = listings if area == "neighbourhood_cleansed" else listings.withColumnRenamed(area, "neighbourhood_cleansed")
    keys = [*within, "neighbourhood_cleansed"]
    price = price_column(src)
    aggs = {"neighbourhood_listing_count": F.count(F.lit(1))}
    if price:
        aggs["neighbourhood_mean_price"] = stable_round(F.avg(price), 2)
    if "review_scores_rating" in src.columns:
        aggs["neighbourhood_avg_rating"] = stable_round(F.avg("review_scores_rating"), 2)
    if "availability_365" in src.columns:
        aggs["neighbourhood_avg_availability"] = stable_round(F.avg("availability_365"), 1)
    if price:
        aggs["neighbourhood_median_price"] = _median(F.col(price))
    out = src.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    if reference is not None:
        ref = reference.withColumnRenamed("neighbourhood_name", "neighbourhood_cleansed")
        out = out.join(ref, keys, "left")
    return out


def join_master(listings: DataFrame, calendar: DataFrame | None, reviews: DataFrame | None,
                areas: DataFrame | None, within: list[str] = []) -> DataFrame:
    """Left joins of the three aggregates; each aggregate has one row per key, so rows never multiply."""
    key = listing_key(listings)
    out = listings
    for agg in (calendar, reviews):
        if agg is not None:
            side = agg if key == "listing_id" else agg.withColumnRenamed("listing_id", key)
            out = out.join(side, [*within, key], "left")
    area = first_present(out, AREA_NAMES)
    if areas is not None and area is not None:
        side = areas if area == "neighbourhood_cleansed" else areas.withColumnRenamed("neighbourhood_cleansed", area)
        out = out.join(side, [*within, area], "left")
    return out


def join_coverage(master: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of listings that found each aggregate."""
    marks = {"calendar": "total_days", "reviews": "review_count_computed",
             "neighbourhood": "neighbourhood_listing_count"}
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return master.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("listings_count"),
        *[stable_round(ratio(F.count(c), n, 100), 1).alias(f"{k}_coverage_pct")
          for k, c in marks.items() if c in master.columns])


def derive_measures(df: DataFrame, scrape_date: str | Column = "scrape_date",
                    professional_min: int = settings.PROFESSIONAL_MIN_LISTINGS,
                    months: int = settings.ACTIVE_REVIEW_MONTHS,
                    min_availability: int = settings.ACTIVE_MIN_AVAILABILITY) -> DataFrame:
    """Business measures of a listing; a measure whose inputs are absent is left out."""
    day = F.col(scrape_date) if isinstance(scrape_date, str) else scrape_date
    has = set(df.columns).__contains__
    out = df
    if has("price") and not has("price_local"):
        out = out.withColumn("price_local", F.col("price"))
    price = price_column(out)
    new: dict[str, Column] = {}
    if has("host_since"):
        new["host_tenure_years"] = stable_round(F.datediff(day, "host_since") / 365.25, 2)
    if has("number_of_reviews") and has("first_review"):
        age = F.greatest(F.datediff(day, "first_review") / 30.44, F.lit(1.0))
        new["review_frequency_monthly"] = F.when(F.col("first_review").isNotNull() & (F.col("number_of_reviews") > 0),
                                                 stable_round(ratio("number_of_reviews", age), 2))
    if price:
        for count, name in (("bedrooms", "price_per_bedroom"), ("accommodates", "price_per_person")):
            if has(count):
                new[name] = F.when(F.col(count) > 0, stable_round(ratio(price, count), 2))
    if has("last_review") and has("availability_365"):
        since = F.date_sub(day, round(months * 30.44))
        new["is_active"] = (F.coalesce(F.col("last_review") >= since, F.lit(False))
                            | F.coalesce(F.col("availability_365") >= min_availability, F.lit(False)))
    hosts = first_present(out, ["calculated_host_listings_count", "host_listings_count", "host_total_listings_count"])
    if hosts:
        new["is_professional_host"] = F.coalesce(F.col(hosts) >= professional_min, F.lit(False))
    if new:
        out = out.withColumns(new)
    if not has("estimated_monthly_revenue") and has("occupancy_rate_pct"):
        base = "avg_booked_price" if has("avg_booked_price") else price
        if base:
            out = out.withColumn("estimated_monthly_revenue", monthly_revenue(base))
    if "estimated_annual_revenue" not in out.columns and "estimated_monthly_revenue" in out.columns:
        out = out.withColumn("estimated_annual_revenue", stable_round(F.col("estimated_monthly_revenue") * 12, 2))
    if price and has("neighbourhood_median_price"):
        out = out.withColumn("price_vs_neighbourhood",
                             F.when(F.col("neighbourhood_median_price") > 0,
                                    stable_round(ratio(price, "neighbourhood_median_price"), 3)))
    return out


def add_city_context(df: DataFrame, cities: dict = settings.CITIES, rates: dict = settings.USD_RATES) -> DataFrame:
    """City attributes, snapshot date and USD rate by broadcast of the configured cities (one row per city)."""
    return df.join(F.broadcast(city_context(df.sparkSession, cities, rates)), "city", "left")


def to_usd(df: DataFrame, rate: str | float = "usd_rate", columns: list[str] = USD_COLUMNS) -> DataFrame:
    factor = F.coalesce(F.col(rate), F.lit(1.0)) if isinstance(rate, str) else F.lit(float(rate))
    names = {c: "price_usd" if c == "price_local" else f"{c}_usd" for c in columns if c in df.columns}
    return df.withColumns({n: stable_round(F.col(c) * factor, 2) for c, n in names.items()})


def enrich(listings: DataFrame, calendar: DataFrame | None, reviews: DataFrame | None,
           neighbourhoods: DataFrame | None, cities: dict = settings.CITIES) -> DataFrame:
    """Gold table of all cities in one plan; the city is part of every key."""
    _require(listings, ["city"], "listings")
    within = ["city"]
    ref = neighbourhood_reference(neighbourhoods, within) if neighbourhoods is not None else None
    cal = calendar_by_listing(calendar, ["city", "listing_id"]) if calendar is not None else None
    rev = reviews_by_listing(reviews, ["city", "listing_id"]) if reviews is not None else None
    master = join_master(listings, cal, rev, area_benchmarks(listings, ref, within), within)
    return to_usd(derive_measures(add_city_context(master, cities))).drop("usd_rate")


def enrichment_warnings(calendar: DataFrame | None, reviews: DataFrame | None) -> list[str]:
    return [w for w, df in (("calendar_missing", calendar), ("reviews_missing", reviews)) if df is None]


def wider_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Common type of two columns to be stacked: text over double over long."""
    if a == b:
        return a
    for wide, kinds in ((T.StringType(), (T.StringType,)), (T.DoubleType(), (T.DoubleType, T.FloatType)),
                        (T.LongType(), (T.LongType, T.IntegerType))):
        if isinstance(a, kinds) or isinstance(b, kinds):
            return wide
    return a


def unify(tables: list[DataFrame]) -> DataFrame:
    """Stack tables of different cities: union of columns in name order, widened types, NULL where absent."""
    if len(tables) < 2:
        raise ValueError("at least two tables are needed")
    types: dict[str, T.DataType] = {}
    for df in tables:
        for f in df.schema.fields:
            types[f.name] = wider_type(types.get(f.name, f.dataType), f.dataType)
    names = sorted(types)

    def aligned(df: DataFrame) -> DataFrame:
        have = {f.name: f.dataType for f in df.schema.fields}
        return df.select(*[F.lit(None).cast(types[c]).alias(c) if c not in have
                           else F.col(c) if have[c] == types[c]
                           else F.col(c).try_cast(types[c]).alias(c) for c in names])

    out = aligned(tables[0])
    for df in tables[1:]:
        out = out.unionAll(aligned(df))
    return out


def harmonize(df: DataFrame, kind: str, schema_map: dict = settings.SCHEMA_MAP, keep: list[str] = []) -> DataFrame:
    """Canonical names and types of one raw table; a column without any alias present becomes NULL."""
    from ..functions import parsing as P
    transforms = {"strip_html": P.strip_html_or_null, "parse_rate_pct": P.percent,
                  "parse_boolean": lambda c: P.true_false(c, lenient=True), "clean_price": P.clean_price,
                  "parse_bathrooms_text": P.bathrooms,
                  "parse_amenities": lambda c: F.to_json(P.amenity_list(c)),
                  "parse_host_verifications": lambda c: F.to_json(P.verification_list(c))}
    cols = []
    for target, (aliases, kind_name, transform) in schema_map[kind].items():
        present = [a for a in aliases if a in df.columns]
        if not present:
            cols.append(F.lit(None).cast(kind_name).alias(target))
            continue
        raw = F.coalesce(*[F.col(a) for a in present]) if len(present) > 1 else F.col(present[0])
        if transform:
            value = transforms[transform](raw).cast(kind_name)
        elif kind_name == "date":
            value = P.iso_date(raw)
        else:
            value = P.to_number(raw, kind_name) if kind_name in ("int", "bigint", "double") else raw.cast(kind_name)
        cols.append(value.alias(target))
    return df.select(*keep, *cols)
