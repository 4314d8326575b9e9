"""Registered queries: parsers, bands, filters, joins, aggregates, ordered work, quality, ledger."""

from pyspark.sql import functions as F

from staylens import settings
from staylens.functions import bands, geo
from staylens.functions import parsing as P
from staylens.functions.rounding import ratio, rows
from staylens.operators import cleaning, distribution as D, enrich, harmonize, ledger, ordering, profiling, relations, star
from staylens.operators import quality as Q
from staylens.operators.joins import join_to_unique
from staylens.operators.smooth import smooth_trend
from staylens.sources import readers, sinks

from .layers import fixed, wh
from .market_queries import BASE
from .oracle_base import R, statement
from staylens.plans import explore

ENTRIES: dict[str, tuple] = {}


def op(name, build, sql=None, extra=None, digits=4):
    ENTRIES[name] = (lambda s, d: fixed(build(s, d), digits), statement(sql, extra) if sql else None)


def table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def raw(s, d, kind):
    return readers.blank_tokens_to_null(wh(s, d).raw[kind])


def silver(s, d, kind):
    return wh(s, d).silver[kind]


# ---- parsers over whole raw tables ---------------------------------------------------------------
op("clean_price", lambda s, d: raw(s, d, "listings").select("listing_url", P.clean_price("price").alias("price")),
   "SELECT listing_url, TRY_CAST(trim(regexp_replace(price, '[$€£,]', '', 'g')) AS DOUBLE) price FROM tok_listings")
op("cast_bool", lambda s, d: raw(s, d, "listings").select("listing_url", P.true_false("host_is_superhost").alias("superhost"),
                                                          P.true_false(F.upper("instant_bookable"), lenient=True).alias("instant")),
   "SELECT listing_url, CASE host_is_superhost WHEN 't' THEN true WHEN 'f' THEN false END superhost, "
   "CASE instant_bookable WHEN 't' THEN true WHEN 'f' THEN false END instant FROM tok_listings")
op("parse_date", lambda s, d: raw(s, d, "calendar").groupBy(P.iso_date("date").alias("day")).agg(rows().alias("n")),
   "SELECT TRY_CAST(try_strptime(date, '%Y-%m-%d') AS DATE) AS day, count(*) n FROM tok_calendar GROUP BY 1")
op("clean_percent", lambda s, d: raw(s, d, "listings").select("listing_url", P.percent("host_response_rate").alias("rate")),
   f"SELECT listing_url, {R(chr(84) + 'RY_CAST(trim(replace(host_response_rate, chr(37), chr(32))) AS DOUBLE) / 100', 4)} rate FROM tok_listings")
op("parse_bathrooms", lambda s, d: raw(s, d, "listings").select("listing_url", P.bathrooms("bathrooms_text").alias("bathrooms"),
                                                                P.bathrooms_shared("bathrooms_text").alias("shared")),
   "SELECT listing_url, bathrooms, bathrooms_shared shared FROM (SELECT * EXCLUDE (bathrooms), CASE WHEN regexp_matches(bathrooms_text, '[0-9]') "
   "THEN CAST(regexp_extract(bathrooms_text, '[0-9.]+') AS DOUBLE) WHEN bathrooms_text ILIKE '%half%' THEN 0.5 END bathrooms FROM typed_listings)")
op("count_amenities", lambda s, d: raw(s, d, "listings").select("listing_url", P.amenity_count("amenities").alias("n")),
   "SELECT listing_url, amenity_count n FROM typed_listings")
_AMEN = ("CASE WHEN amenities LIKE '[%' THEN list_sort(list_distinct(list_transform(from_json(amenities, '[\"VARCHAR\"]'), lambda x: trim(x)))) "
         "WHEN amenities LIKE '{%' THEN list_sort(list_distinct(list_transform(string_split(amenities[2:-2], ','), lambda x: trim(x, '\"')))) ELSE [] END")
op("parse_amenities", lambda s, d: raw(s, d, "listings").select("listing_url", F.array_join(P.amenity_list("amenities"), "|").alias("items"),
                                                                F.size(P.amenity_list("amenities")).alias("n")),
   f"SELECT listing_url, array_to_string(a, '|') items, len(a)::INT n FROM (SELECT listing_url, {_AMEN} a FROM tok_listings)")
op("count_verifications", lambda s, d: raw(s, d, "listings").select("listing_url", P.verification_count("host_verifications").alias("n")),
   "SELECT listing_url, host_verification_count n FROM typed_listings")
op("parse_verifications", lambda s, d: raw(s, d, "listings").select(
    "listing_url", F.array_join(P.verification_list("host_verifications"), "|").alias("items")),
   "SELECT listing_url, CASE WHEN host_verifications LIKE '%email%' THEN 'email|phone' WHEN host_verifications LIKE '%phone%' THEN 'phone' "
   "ELSE '' END items FROM tok_listings")
_HT = "trim(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '&amp;', '&', 'g'), ' \n\t\r')"
op("strip_html", lambda s, d: raw(s, d, "reviews").select("id", P.strip_html("comments").alias("text")),
   "SELECT id, " + _HT.format(c="comments") + " AS text FROM tok_reviews")
op("strip_html_pages", lambda s, d: table(s, d, "pages").select("page_id", F.length(P.strip_html_or_null("html")).alias("n")),
   "SELECT page_id, length(nullif(trim(replace(trim(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), "
   "'&quot;', '\"'), ' \n\t\r'), '&#39;', '''')), ''))::INT n FROM pages")
op("normalize_text", lambda s, d: table(s, d, "documents").select("doc_id", F.md5(P.tidy_text("text")).alias("digest")),
   "SELECT doc_id, md5(regexp_replace(trim(text, ' \n\t\r'), '\\s{2,}', ' ', 'g')) digest FROM documents")
op("detect_currency", lambda s, d: raw(s, d, "listings").groupBy("city", P.price_currency("price").alias("mark")).agg(rows().alias("n")),
   "SELECT city, CASE WHEN price LIKE '%$%' THEN '$' WHEN price LIKE '%€%' THEN '€' WHEN price LIKE '%£%' THEN '£' END mark, count(*) n "
   "FROM tok_listings GROUP BY 1, 2")
op("column_parsers", lambda s, d: cleaning.apply_parsers(
    raw(s, d, "listings"), {"price": ["price"], "special": {"amenities": "wifi"}},
    {"wifi": lambda c: {"has_wifi": F.lower(F.col(c)).contains("wifi")}}).groupBy("has_wifi").agg(
    rows().alias("n"), F.avg("price").alias("avg_price")),
   f"SELECT lower(amenities) LIKE '%wifi%' has_wifi, count(*) n, {R('avg(price)', 4)} avg_price FROM (SELECT t.amenities, "
   "TRY_CAST(trim(regexp_replace(t.price, '[$€£,]', '', 'g')) AS DOUBLE) price FROM tok_listings t) GROUP BY 1")
_H = ["listing_id", "description", "host_response_rate", "host_is_superhost", "host_listings_count", "host_verifications",
      "bathrooms", "bedrooms", "amenities", "price_local", "first_review", "license", "instant_bookable"]
op("harmonize", lambda s, d: enrich.harmonize(raw(s, d, "listings"), "listings", keep=["listing_url"]).drop("listing_url").join(
    raw(s, d, "listings").select(F.col("id").cast("long").alias("listing_id")), "listing_id").select(*_H),
   f"SELECT id listing_id, nullif(trim(replace({_HT.format(c='description')}, '&#39;', '''')), '') description, {R('host_response_rate', 4)} host_response_rate, "
   "host_is_superhost, coalesce(host_listings_count, host_total_listings_count) host_listings_count, "
   "CASE WHEN host_verifications LIKE '%email%' THEN '[\"email\",\"phone\"]' WHEN host_verifications LIKE '%phone%' THEN '[\"phone\"]' ELSE '[]' END host_verifications, "
   f"bathrooms, bedrooms, '[' || array_to_string(list_transform({_AMEN}, lambda x: '\"' || x || '\"'), ',') || ']' amenities, price price_local, first_review, license, instant_bookable "
   "FROM typed_listings WHERE id IS NOT NULL")
op("first_existing_column", lambda s, d: silver(s, d, "listings").groupBy(F.col(
    P.first_present(silver(s, d, "listings"), ["neighbourhood_name", "neighbourhood_cleansed"])).alias("area")).agg(rows().alias("n")),
   "SELECT neighbourhood_cleansed area, count(*) n FROM s_listings GROUP BY 1")
op("cast_first_existing", lambda s, d: raw(s, d, "listings").select(
    P.cast_first(raw(s, d, "listings"), ["listing_id", "id"], "bigint").alias("listing_id"),
    P.cast_first(raw(s, d, "listings"), ["no_such"], "int").alias("absent"),
    P.coalesce_present(raw(s, d, "listings"), ["bedrooms", "beds"], "int").alias("rooms"),
    P.to_number((F.col("accommodates").cast("double") + 1) / 2, "int").alias("half_even")),
   "SELECT TRY_CAST(id AS BIGINT) listing_id, NULL::INT absent, TRY_CAST(coalesce(bedrooms, beds) AS INT) rooms, "
   "TRY_CAST((accommodates::DOUBLE + 1) / 2 AS INT) half_even FROM tok_listings")
op("city_context", lambda s, d: enrich.add_city_context(silver(s, d, "listings")).groupBy(
    "city", "city_display_name", "country", "currency_code", "timezone", "scrape_date", "usd_rate").agg(rows().alias("n")),
   "SELECT g.city, city_display_name, c.country, g.currency_code, c.timezone, scrape_date, "
   "if(g.currency_code = 'USD', 1.0, 1.08)::DOUBLE usd_rate, count(*) n FROM gold g JOIN dim_city c ON c.city_name = g.city GROUP BY ALL")
op("to_usd", lambda s, d: enrich.to_usd(silver(s, d, "listings").withColumn("price_local", F.col("price")), 1.27).select("listing_url", "price_usd"),
   f"SELECT listing_url, {R('price * 1.27e0', 2)} price_usd FROM s_listings")
op("usd_by_city", lambda s, d: enrich.to_usd(enrich.add_city_context(silver(s, d, "calendar")).withColumn("price_local", F.col("price")))
   .groupBy("city").agg(F.sum("price_usd").alias("usd")), f"SELECT city, {R('sum(price_usd)', 2)} usd FROM (SELECT l.city, "
   + R("l.price * CASE WHEN l.city = 'new_york_city' THEN 1e0 ELSE 1.08e0 END", 2) + " price_usd FROM s_calendar l) GROUP BY city", digits=2)
op("schema_hash", lambda s, d: raw(s, d, "listings").select("listing_url", P.schema_hash_column(P.amenity_list("amenities")).alias("digest")),
   f"SELECT listing_url, md5(array_to_string({_AMEN}, '|')) digest FROM tok_listings")

# ---- measures, bands, dates, distances -----------------------------------------------------------
_M = ["city", "id", "host_tenure_years", "review_frequency_monthly", "price_per_bedroom", "price_per_person", "is_active", "is_professional_host"]
op("derive_measures", lambda s, d: enrich.derive_measures(enrich.add_city_context(silver(s, d, "listings"))).select(*_M),
   "SELECT " + ", ".join(f"{R(c, 4)} {c}" if c.endswith(("years", "monthly", "bedroom", "person")) else c for c in _M) + " FROM gold")
op("revenue_fallback", lambda s, d: enrich.derive_measures(enrich.add_city_context(
    wh(s, d).gold.select("city", "id", "price", "occupancy_rate_pct"))).select("city", "id", "estimated_monthly_revenue", "estimated_annual_revenue"),
   f"SELECT city, id, m estimated_monthly_revenue, {R('m * 12', 2)} estimated_annual_revenue FROM (SELECT city, id, "
   f"{R('occupancy_rate_pct / 100 * price * 30', 2)} m FROM gold)")
_BANDS = {"b": """SELECT *, CASE WHEN price_vs_neighbourhood > 1.2 THEN 'Premium (>120% median)' WHEN price_vs_neighbourhood >= 0.8 THEN 'Mid-range (80-120%)'
 WHEN price_vs_neighbourhood < 0.8 THEN 'Budget (<80% median)' ELSE 'Unknown' END seg FROM gold"""}
op("price_segment", lambda s, d: wh(s, d).gold.groupBy(bands.price_segment("price_vs_neighbourhood").alias("seg")).agg(rows().alias("n")),
   "SELECT seg, count(*) n FROM b GROUP BY 1", _BANDS)
op("tenure_band", lambda s, d: wh(s, d).gold.filter("host_tenure_years IS NOT NULL").groupBy(bands.tenure_band("host_tenure_years").alias("band")).agg(rows().alias("n")),
   "SELECT CASE WHEN host_tenure_years < 1 THEN '< 1 year' WHEN host_tenure_years < 3 THEN '1-3 years' WHEN host_tenure_years < 5 THEN '3-5 years' "
   "WHEN host_tenure_years < 10 THEN '5-10 years' ELSE '10+ years' END band, count(*) n FROM gold WHERE host_tenure_years IS NOT NULL GROUP BY 1")
op("portfolio_segment", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(rows().alias("n")).groupBy(
    bands.portfolio_segment("n").alias("segment")).agg(rows().alias("hosts")),
   "SELECT CASE WHEN n = 1 THEN 'Single Listing' WHEN n <= 4 THEN 'Small Portfolio (2-4)' WHEN n <= 20 THEN 'Professional (5-20)' ELSE 'Enterprise (20+)' END segment, "
   "count(*) hosts FROM (SELECT count(*) n FROM orders GROUP BY o_custkey) GROUP BY 1")
op("review_bin", lambda s, d: silver(s, d, "listings").groupBy(bands.review_bin("number_of_reviews").alias("bin")).agg(rows().alias("n")),
   "SELECT CASE WHEN number_of_reviews <= 0 THEN NULL WHEN number_of_reviews <= 5 THEN '1-5' WHEN number_of_reviews <= 10 THEN '6-10' WHEN number_of_reviews <= 25 THEN '11-25' "
   "WHEN number_of_reviews <= 50 THEN '26-50' WHEN number_of_reviews <= 100 THEN '51-100' ELSE '101-200' END bin, count(*) n FROM s_listings GROUP BY 1")
op("flag_labels", lambda s, d: silver(s, d, "listings").groupBy(
    bands.yes_no_label("host_is_superhost", "Superhost", "Regular").alias("kind"),
    bands.flag_label("instant_bookable", "Instant", "Request").alias("booking")).agg(rows().alias("n")),
   "SELECT CASE WHEN host_is_superhost THEN 'Superhost' WHEN NOT host_is_superhost THEN 'Regular' END kind, "
   "if(instant_bookable, 'Instant', 'Request') booking, count(*) n FROM s_listings GROUP BY 1, 2")
op("date_parts", lambda s, d: table(s, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("x")).distinct().select(
    *[e.alias(n) for n, e in bands.date_parts("x").items()]),
   "SELECT strftime(x, '%Y%m%d')::INT date_key, x full_date, year(x) AS year, quarter(x) AS quarter, month(x) AS month, day(x) day_of_month, "
   "strftime(x, '%w')::INT day_of_week, strftime(x, '%A') day_name, strftime(x, '%B') month_name, strftime(x, '%w') IN ('0', '6') is_weekend, "
   "strftime(x, '%W')::INT week_of_year FROM (SELECT DISTINCT l_shipdate::DATE x FROM lineitem)")
op("period_column", lambda s, d: table(s, d, "orders").groupBy(bands.month_start(F.year("o_orderdate"), F.month("o_orderdate")).alias("period")).agg(
    rows().alias("n")), "SELECT date_trunc('month', o_orderdate)::DATE period, count(*) n FROM orders GROUP BY 1")
op("comment_length", lambda s, d: silver(s, d, "reviews").groupBy(F.length("comments").alias("comment_length")).agg(rows().alias("n")),
   "SELECT length(comments)::INT comment_length, count(*) n FROM s_reviews GROUP BY 1")
op("safe_ratio", lambda s, d: silver(s, d, "listings").select("listing_url", ratio("price", "bedrooms").alias("per_bedroom")),
   f"SELECT listing_url, {R('price / nullif(bedrooms, 0)', 4)} per_bedroom FROM s_listings")
_LL = "radians(latitude) la, radians(longitude) lo, radians(clat) cla, radians(clon) clo"
_CC = "CASE city WHEN 'new_york_city' THEN 40.7128e0 END clat, CASE city WHEN 'new_york_city' THEN -74.0060e0 END clon"
op("centre_distance", lambda s, d: geo.with_centre_distance(silver(s, d, "listings"), settings.CITY_CENTRES, "city", "latitude", "longitude")
   .select("city", "id", "distance_to_centre_km"),
   f"SELECT city, id, {R('2 * 6371e0 * asin(sqrt(pow(sin((cla - la) / 2), 2) + cos(la) * cos(cla) * pow(sin((clo - lo) / 2), 2)))', 4)} distance_to_centre_km "
   f"FROM (SELECT city, id, {_LL} FROM (SELECT *, {_CC} FROM s_listings))")
op("flat_distance", lambda s, d: silver(s, d, "listings").select("city", "id", geo.flat_km("latitude", "longitude", F.lit(52.37), F.lit(4.9)).alias("km")),
   f"SELECT city, id, {R('sqrt(pow((4.9e0 - longitude) * cos(radians((latitude + 52.37e0) / 2)), 2) + pow(52.37e0 - latitude, 2)) * 111.32e0', 4)} km FROM s_listings")

# ---- filters and trims ----------------------------------------------------------------------------
op("quantile_trim", lambda s, d: D.trim_at(silver(s, d, "calendar"), "price", 0.99).groupBy("city").agg(rows().alias("n"), F.max("price").alias("top")),
   f"SELECT city, count(*) n, {R('max(price)', 4)} top FROM s_calendar WHERE price <= (SELECT quantile_cont(price, 0.99) FROM s_calendar) GROUP BY city")
op("winsorise", lambda s, d: D.winsorise(table(s, d, "lineitem"), "l_extendedprice").groupBy("l_returnflag").agg(
    F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.avg("l_extendedprice").alias("mean")),
   f"SELECT l_returnflag, {R('min(x)', 4)} lo, {R('max(x)', 4)} hi, {R('avg(x)', 4)} mean FROM (SELECT l_returnflag, least(greatest(l_extendedprice, a), b) x FROM lineitem, "
   "(SELECT quantile_cont(l_extendedprice, 0.01) a, quantile_cont(l_extendedprice, 0.99) b FROM lineitem)) GROUP BY 1")
op("range_guard", lambda s, d: silver(s, d, "calendar").filter("minimum_nights > 0 AND minimum_nights < 365 AND price BETWEEN 1000 AND 50000").groupBy(
    "minimum_nights").agg(rows().alias("n")), "SELECT minimum_nights, count(*) n FROM s_calendar WHERE minimum_nights > 0 AND minimum_nights < 365 AND price BETWEEN 1000 AND 50000 GROUP BY 1")
op("positive_price", lambda s, d: explore._priced_calendar(wh(s, d).star).groupBy("city").agg(rows().alias("n"), F.avg("price").alias("mean")),
   f"SELECT city, count(*) n, {R('avg(price)', 4)} mean FROM cal WHERE price > 0 GROUP BY city", {"cal": BASE["cal"]})
op("complete_cases", lambda s, d: silver(s, d, "listings").dropna(subset=settings.SUB_SCORES).groupBy("city").agg(rows().alias("n")),
   "SELECT city, count(*) n FROM s_listings WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in settings.SUB_SCORES) + " GROUP BY 1")
op("large_groups", lambda s, d: D.groups_with(silver(s, d, "listings"), ["property_type", "room_type"], 15).groupBy("property_type", "room_type").agg(rows().alias("n")),
   "SELECT property_type, room_type, count(*) n FROM s_listings GROUP BY 1, 2 HAVING count(*) >= 15")

# ---- imputation, joins, keys ------------------------------------------------------------------------
op("impute_missing", lambda s, d: cleaning.fill_missing(table(s, d, "part").select(
    "p_partkey", "p_brand", F.when(F.col("p_partkey") % 11 != 3, F.col("p_size")).alias("size"),
    F.when(F.col("p_partkey") % 7 != 1, F.col("p_retailprice")).alias("price"), F.when(F.col("p_partkey") % 5 != 1, F.col("p_name")).alias("name"),
    F.when(F.col("p_partkey") % 6 != 2, F.col("p_size")).alias("stock")),
    {"size": {"strategy": "impute_median_by_group", "group_columns": ["p_brand"]}, "price": {"strategy": "impute_median_by_group"},
     "name": {"strategy": "sentinel", "fill_value": "Unnamed"}, "stock": {"strategy": "impute_zero"}}).select(
    "p_partkey", F.col("size").cast("double").alias("size"), "price", "name", "stock", F.col("_size_imputed").alias("size_imputed")),
   f"SELECT p_partkey, {R('coalesce(sz, median(sz) OVER (PARTITION BY p_brand))', 4)} size, {R('coalesce(pr, median(pr) OVER ())', 4)} price, "
   "coalesce(nm, 'Unnamed') AS name, coalesce(st, 0) stock, sz IS NULL size_imputed FROM (SELECT p_partkey, p_brand, if(p_partkey % 11 <> 3, p_size, NULL)::DOUBLE sz, "
   "if(p_partkey % 7 <> 1, p_retailprice, NULL) pr, if(p_partkey % 5 <> 1, p_name, NULL) nm, if(p_partkey % 6 <> 2, p_size, NULL) st FROM part)")
op("join_master", lambda s, d: enrich.join_master(
    table(s, d, "part").select(F.col("p_partkey").alias("listing_id"), "p_name"),
    enrich.calendar_by_listing(table(s, d, "lineitem").select(
        F.col("l_partkey").alias("listing_id"), (F.col("l_returnflag") == "N").alias("available"), F.col("l_extendedprice").alias("price"))),
    None, None).select("listing_id", "p_name", "total_days", "days_booked", "occupancy_rate_pct"),
   f"SELECT p_partkey listing_id, p_name, n total_days, b::BIGINT days_booked, {R('b * 100e0 / n', 2)} occupancy_rate_pct FROM part LEFT JOIN (SELECT l_partkey, count(*) n, "
   "count(*) FILTER (l_returnflag <> 'N') b FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
op("hot_key_join", lambda s, d: join_to_unique(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 3 == 0, F.lit(7).cast("long"))
                                                                              .when(F.col("l_suppkey") % 5 == 4, -F.col("l_suppkey")).when(F.col("l_suppkey") % 3 == 1, F.col("l_suppkey")).alias("s_suppkey"), "l_quantity"),
                                               table(s, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], hot_rows=3000)
   .groupBy("s_suppkey", "s_name").agg(rows().alias("n"), F.sum("l_quantity").alias("quantity")),
   "SELECT k s_suppkey, s_name, count(*) n, sum(l_quantity) quantity FROM (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 7 WHEN l_suppkey % 5 = 4 THEN -l_suppkey WHEN l_suppkey % 3 = 1 THEN l_suppkey END k, l_quantity FROM lineitem) "
   "LEFT JOIN supplier ON s_suppkey = k GROUP BY 1, 2")
op("area_reference", lambda s, d: enrich.neighbourhood_reference(silver(s, d, "neighbourhoods"), ["city"]),
   "SELECT DISTINCT city, neighbourhood neighbourhood_name, neighbourhood_group FROM s_neighbourhoods")
op("surrogate_keys", lambda s, d: ordering.dense_keys(table(s, d, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority", "o_orderkey"], "row_key"),
   "SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) row_key, o_orderpriority, o_orderkey FROM orders")
op("spread_surrogate_keys", lambda s, d: ordering.dense_keys(table(s, d, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority", "o_orderkey"], "row_key", 0),
   "SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) row_key, o_orderpriority, o_orderkey FROM orders")


def _reviews_without_ids(s, d):
    """The review fact over reviews of which every third has no id."""
    w = wh(s, d)
    some = silver(s, d, "reviews").withColumn("id", F.when(F.col("id") % 3 != 0, F.col("id")))
    return star.fact_review(s, some, *[w.star[t] for t in ("fact_listing_snapshot", "dim_reviewer", "dim_city", "dim_date")])


op("fallback_review_ids", _reviews_without_ids,
   """SELECT coalesce(CASE WHEN id % 3 <> 0 THEN id END, n) review_id, f.listing_key, w.reviewer_key, d.date_key review_date_key, comment_length FROM (
 SELECT *, length(comments)::INT comment_length, row_number() OVER (ORDER BY city NULLS FIRST, listing_id NULLS FIRST, date NULLS FIRST, reviewer_id NULLS FIRST, length(comments) NULLS FIRST,
 CASE WHEN id % 3 <> 0 THEN id END NULLS FIRST) n FROM s_reviews) r LEFT JOIN snap_city f ON r.listing_id = f.listing_id AND r.city = f.city
 LEFT JOIN dim_reviewer w ON r.reviewer_id = w.reviewer_id LEFT JOIN dim_date d ON r.date = d.full_date""")
op("key_intersection", lambda s, d: relations.matched_keys(table(s, d, "documents"), table(s, d, "labels"), "doc_id", "doc_id"),
   "SELECT DISTINCT doc_id AS key FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
op("key_difference", lambda s, d: relations.orphan_keys(table(s, d, "orders").filter("o_orderstatus <> 'P'"), table(s, d, "lineitem"), "o_orderkey", "l_orderkey"),
   "SELECT l_orderkey AS key, count(*) child_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
op("orphan_examples", lambda s, d: relations.orphan_examples(table(s, d, "orders").filter("o_orderstatus <> 'P'"), table(s, d, "lineitem"), "o_orderkey", "l_orderkey"),
   "SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ORDER BY 1 LIMIT 10")
_REFS = [("orders_to_customer", "customer", "c_custkey", "orders", "o_custkey"), ("lineitem_to_open_orders", "orders WHERE o_orderstatus = 'O'", "o_orderkey", "lineitem", "l_orderkey"),
         ("labels_to_documents", "documents", "doc_id", "labels", "doc_id")]


def _ref_sql(name, parent, pk, child, fk):
    p, c = f"(SELECT DISTINCT {pk} k FROM {parent})", f"(SELECT {fk} k, count(*) n FROM {child} GROUP BY 1)"
    return (f"SELECT '{name}' relationship, (SELECT count(*) FROM {p}) parent_unique_values, count(*) child_unique_values, count(p.k) matched_values, "
            f"count(*) - count(p.k) orphan_values, coalesce(sum(n) FILTER (p.k IS NULL), 0)::BIGINT orphan_rows, "
            f"{R('count(p.k) * 100e0 / count(*)', 2)} coverage_pct, count(*) = count(p.k) is_valid FROM {c} c LEFT JOIN {p} p ON p.k = c.k")


op("referential_integrity", lambda s, d: D.rows_union([
    relations.reference_report(table(s, d, p.split()[0]).filter("o_orderstatus = 'O'") if "WHERE" in p else table(s, d, p), table(s, d, c), pk, fk, n)
    for n, p, pk, c, fk in _REFS]), " UNION ALL ".join(_ref_sql(*r) for r in _REFS))
op("primary_keys", lambda s, d: D.rows_union([
    relations.primary_key_report(table(s, d, "orders"), ["o_orderkey"], "orders"),
    relations.primary_key_report(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem"),
    relations.primary_key_report(raw(s, d, "listings"), ["id"], "listings")]),
   " UNION ALL ".join(f"SELECT '{t}' file_type, '{k}' key_columns, count(*) total_rows, (SELECT count(*) FROM (SELECT DISTINCT {k} FROM {src})) unique_keys, "
                      f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {k} FROM {src})) duplicate_keys, count(*) FILTER ({k.split(',')[0]} IS NULL) null_keys, "
                      f"count(*) = (SELECT count(*) FROM (SELECT DISTINCT {k} FROM {src})) AND count(*) FILTER ({k.split(',')[0]} IS NULL) = 0 AS valid FROM {src}"
                      for t, k, src in (("orders", "o_orderkey", "orders"), ("lineitem", "l_orderkey,l_linenumber", "lineitem"), ("listings", "id", "tok_listings"))))


def _per_key_sql(name, src, key):
    return (f"SELECT '{name}' statistic, {R('avg(n)', 1)} mean, median(n)::DOUBLE AS median, min(n) AS min, max(n) AS max, count(*) AS keys, "
            f"count(*) FILTER (n > 1) multi_row_keys FROM (SELECT count(*) n FROM {src} GROUP BY {key})")


op("rows_per_key", lambda s, d: D.rows_union([relations.rows_per_key(table(s, d, "lineitem"), "l_partkey", "days"),
                                              relations.rows_per_key(table(s, d, "events"), "user_id", "events")]),
   _per_key_sql("days", "lineitem", "l_partkey") + " UNION ALL " + _per_key_sql("events", "events", "user_id"))
_PKS = [("listings", "id"), ("calendar", "listing_id,date"), ("reviews", "id"), ("neighbourhoods", "neighbourhood")]
op("relationship_report", lambda s, d: relations.relationship_report({k: raw(s, d, k) for k in settings.PRIMARY_KEYS})["references"],
   " UNION ALL ".join(_ref_sql(n, f"tok_{p} WHERE {pk} IS NOT NULL", pk, f"(SELECT * FROM tok_{c} WHERE {fk} IS NOT NULL)", fk)
                      for n, p, pk, c, fk in settings.RELATIONS))
op("relationship_rows_per_key", lambda s, d: relations.relationship_report({k: raw(s, d, k) for k in settings.PRIMARY_KEYS})["rows_per_key"],
   " UNION ALL ".join(_per_key_sql(n, f"tok_{t}", k) for n, t, k in (("calendar_per_listing", "calendar", "listing_id"),
                                                                     ("reviews_per_listing", "reviews", "listing_id"), ("listings_per_host", "listings", "host_id"))))

# ---- aggregates ------------------------------------------------------------------------------------
op("describe", lambda s, d: D.describe(table(s, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice"]),
   " UNION ALL ".join(f"SELECT l_returnflag, '{c}' variable, count({c}) n, {R(f'avg({c})', 4)} mean, {R(f'stddev_samp({c})', 4)} std, {R(f'skewness({c})', 4)} skewness, "
                      f"{R(f'kurtosis({c})', 4)} kurtosis, {R(f'quantile_cont({c}, 0.25)', 4)} q1, {R(f'median({c})', 4)} AS median, {R(f'quantile_cont({c}, 0.75)', 4)} q3, "
                      f"{R(f'quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)', 4)} iqr FROM lineitem GROUP BY 1" for c in ("l_quantity", "l_extendedprice")))
op("grouped_medians", lambda s, d: ordering.medians(table(s, d, "lineitem"), ["l_suppkey"], {"price": "l_extendedprice", "quantity": "l_quantity"}),
   f"SELECT l_suppkey, {R('median(l_extendedprice)', 4)} price, {R('median(l_quantity)', 4)} quantity FROM lineitem GROUP BY 1")
_Q5 = {f"p{int(q * 100)}_{k}": (c, q) for k, c in (("price", "l_extendedprice"), ("quantity", "l_quantity")) for q in (0, .05, .5, .99, 1)}
op("spread_quantiles", lambda s, d: ordering.exact_quantiles(table(s, d, "lineitem"), ["l_returnflag"], _Q5, one_task_rows=0),
   "SELECT l_returnflag, " + ", ".join(f"{R(f'quantile_cont({c}, {q})', 4)} {n}" for n, (c, q) in _Q5.items()) + " FROM lineitem GROUP BY 1")
op("spread_median_of_all", lambda s, d: ordering.exact_quantiles(table(s, d, "events"), [], {"median": ("value", .5)}, with_count=True, one_task_rows=0),
   f"SELECT {R('median(value)', 4)} AS median, count(value) n_median FROM events")
op("distinct_counts", lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders")),
   "SELECT l_returnflag, count(DISTINCT l_partkey) parts, count(DISTINCT l_orderkey) orders FROM lineitem GROUP BY 1")
_PR = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
op("crosstab", lambda s, d: D.crosstab(table(s, d, "orders"), "o_orderstatus", "o_orderpriority", _PR),
   "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in _PR) + " FROM orders GROUP BY 1")
op("crosstab_row_percent", lambda s, d: D.row_percent(D.crosstab(table(s, d, "orders"), "o_orderstatus", "o_orderpriority", _PR), "o_orderstatus"),
   "SELECT o_orderstatus, " + ", ".join(f"{R(f'count(*) FILTER (o_orderpriority = {chr(39)}{p}{chr(39)}) * 100e0 / count(*)', 4)} AS \"{p}\"" for p in _PR) + " FROM orders GROUP BY 1")
op("pivot_means", lambda s, d: D.pivot_values(table(s, d, "events").withColumn("m", F.month("ts")), ["event_type"], "m", list(range(1, 13)),
                                              lambda c: F.avg(F.when(c, F.col("value"))), "m"),
   "SELECT event_type, " + ", ".join(f"{R(f'avg(value) FILTER (month(ts) = {m})', 4)} m{m}" for m in range(1, 13)) + " FROM events GROUP BY 1")
op("unpivot_scores", lambda s, d: D.unpivot(silver(s, d, "listings"), ["city", "id"], settings.SUB_SCORES, "dimension", "score").filter("score IS NOT NULL"),
   " UNION ALL ".join(f"SELECT city, id, '{c}' dimension, {R(c, 4)} score FROM s_listings WHERE {c} IS NOT NULL" for c in settings.SUB_SCORES))
op("modes", lambda s, d: D.modes(silver(s, d, "listings"), ["city"], "property_type"),
   "SELECT city, property_type AS mode FROM (SELECT city, property_type, row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, property_type) k "
   "FROM s_listings GROUP BY 1, 2) WHERE k = 1")
op("top_values", lambda s, d: D.top_values(table(s, d, "documents"), "source", 10),
   "SELECT source AS value, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
op("variances", lambda s, d: D.variances(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]),
   " UNION ALL ".join(f"SELECT '{c}' dimension, {R(f'var_samp({c})', 6)} variance FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")), digits=6)
op("density_grid", lambda s, d: D.density_grid(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", 5, 10000, ["l_returnflag"]),
   "SELECT l_returnflag, floor(l_quantity / 5)::BIGINT x_cell, floor(l_extendedprice / 10000)::BIGINT y_cell, count(*) n FROM lineitem GROUP BY ALL")
op("year_growth", lambda s, d: D.growth(table(s, d, "orders").withColumn("year", F.year("o_orderdate")), ["o_orderstatus"], "year", F.sum("o_totalprice")),
   f"SELECT o_orderstatus, year, {R('t', 2)} total, {R('(t / lag(t) OVER (PARTITION BY o_orderstatus ORDER BY year) - 1) * 100', 2)} growth_pct FROM "
   "(SELECT o_orderstatus, year(o_orderdate) AS year, sum(o_totalprice) t FROM orders GROUP BY 1, 2)", digits=2)
op("lorenz_curve", lambda s, d: D.lorenz(table(s, d, "orders").groupBy("o_custkey").agg(rows().alias("n")), [], "n").select("n", "holders", "holder_share", "value_share"),
   f"SELECT n, h holders, {R('sum(h) OVER (ORDER BY n) / sum(h) OVER ()', 4)} holder_share, {R('sum(h * n) OVER (ORDER BY n) / sum(h * n) OVER ()', 4)} value_share FROM "
   "(SELECT n, count(*) h FROM (SELECT count(*) n FROM orders GROUP BY o_custkey) GROUP BY n)")
op("gini", lambda s, d: D.gini(table(s, d, "orders").groupBy("o_orderstatus", "o_custkey").agg(rows().alias("n")), ["o_orderstatus"], "n"),
   f"""SELECT o_orderstatus, n holders, t::DOUBLE total, {R('1 - 2 * a / n / t', 4)} gini FROM (SELECT o_orderstatus, max(k) n, max(t) t, sum((c + c - v) / 2) FILTER (r > 1) a FROM (
 SELECT o_orderstatus, v, row_number() OVER w r, sum(v) OVER w c, count(*) OVER (PARTITION BY o_orderstatus) k, sum(v) OVER (PARTITION BY o_orderstatus) t FROM
 (SELECT o_orderstatus, o_custkey, count(*) v FROM orders GROUP BY 1, 2) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY v, o_custkey ROWS UNBOUNDED PRECEDING)) GROUP BY 1)""")
op("top_holder_shares", lambda s, d: D.top_shares(table(s, d, "orders").groupBy("o_custkey").agg(rows().alias("n")), [], "n"),
   f"""SELECT p top_percent, k top_holders, held::DOUBLE held, {R('held * 100e0 / t', 4)} share_pct FROM (SELECT p, max(k) k, sum(v) FILTER (r <= k) held, sum(v) t FROM (
 SELECT v, r, p, greatest(1, floor(c * p / 100))::BIGINT k FROM (SELECT v, row_number() OVER (ORDER BY v DESC, o_custkey) r, count(*) OVER () c FROM
 (SELECT o_custkey, count(*) v FROM orders GROUP BY 1)), (SELECT unnest([1, 5, 10, 20, 50]) p)) GROUP BY p)""")
op("group_correlation", lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r")),
   f"SELECT l_returnflag, {R('corr(l_quantity, l_extendedprice)', 6)} r FROM lineitem GROUP BY 1", digits=6)
op("binned_trend", lambda s, d: D.binned_trend(table(s, d, "lineitem"), "l_extendedprice", "l_quantity", 10),
   f"""SELECT bin, count(*) n, {R('avg(l_extendedprice)', 4)} mean_x, {R('avg(l_quantity)', 4)} mean_y, {R('median(l_quantity)', 4)} median_y FROM (
 SELECT *, len(list_filter(e, lambda x: l_extendedprice > x))::INT bin FROM lineitem, (SELECT quantile_cont(l_extendedprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) e FROM lineitem)) GROUP BY bin""")
_SMOOTH = {"sv": "SELECT l_quantity::DOUBLE x, count(*)::DOUBLE c, sum(l_extendedprice::DOUBLE) sy FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1",
           "sd": "SELECT a.x p, b.x - a.x dx, b.c, b.sy, sum(b.c) OVER (PARTITION BY a.x ORDER BY abs(b.x - a.x)) upto FROM sv a, sv b",
           "sr": "SELECT p, min(abs(dx)) FILTER (upto >= (SELECT greatest(1, floor(0.3e0 * sum(c) + 1e-10)) FROM sv)) reach FROM sd GROUP BY 1",
           "sw": "SELECT p, reach, sum(w * c) s0, sum(w * c * dx) s1, sum(w * c * dx * dx) s2, sum(w * sy) t0, sum(w * sy * dx) t1 FROM "
                 "(SELECT *, if(reach > 0, pow(1 - pow(least(abs(dx) / if(reach > 0, reach, 1), 1), 3), 3), (dx = 0)::INT) w FROM sd JOIN sr USING (p)) GROUP BY 1, 2"}
op("smooth_trend", lambda s, d: smooth_trend(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", passes=0),
   f"SELECT p x, {R('if(s0 * s2 - s1 * s1 > 1e-12 * s0 * s2, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), t0 / s0)', 4)} trend, reach FROM sw", _SMOOTH)
op("price_trends", lambda s, d: D.rows_union([smooth_trend(wh(s, d).gold, c, "price_local").withColumn("feature", F.lit(c))
                                              for c in ("accommodates", "number_of_reviews", "review_scores_rating", "availability_365")]))
op("histogram", lambda s, d: D.histogram(table(s, d, "events"), "value", 20),
   f"""SELECT bin, {R('lo + (hi - lo) / 20 * bin', 4)} lower, {R('lo + (hi - lo) / 20 * (bin + 1)', 4)} upper, n FROM (SELECT least(floor((value - lo) / ((hi - lo) / 20)), 19)::INT bin,
 lo, hi, count(*) n FROM events, (SELECT min(value) lo, max(value) hi FROM events) GROUP BY ALL)""")

# ---- ordered work and sampling -----------------------------------------------------------------------
op("tie_ranks", lambda s, d: ordering.tie_ranks(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity"),
   "SELECT l_returnflag, l_quantity, count(*) n, avg(r)::DOUBLE AS rank FROM (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) r "
   "FROM lineitem) GROUP BY 1, 2")
op("group_positions", lambda s, d: ordering.positions(table(s, d, "orders").select("o_orderstatus", "o_orderdate", "o_orderkey"), ["o_orderstatus"], ["o_orderdate", "o_orderkey"]).select(
    "o_orderkey", "position"), "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS position FROM orders")
op("running_totals", lambda s, d: ordering.running_totals(table(s, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], ["o_orderkey"],
                                                          {"running": "o_totalprice"}).select("o_orderkey", "running"),
   f"SELECT o_orderkey, {R('sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)', 2)} running FROM orders", digits=2)
op("spread_positions", lambda s, d: ordering.positions(table(s, d, "orders").select("o_orderstatus", "o_orderdate", "o_orderkey"), ["o_orderstatus"],
                                                       ["o_orderdate", "o_orderkey"], one_task_rows=0).select("o_orderkey", "position"),
   "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS position FROM orders")
op("spread_tie_ranks", lambda s, d: ordering.tie_ranks(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity", 0),
   "SELECT l_returnflag, l_quantity, count(*) n, avg(r)::DOUBLE AS rank FROM (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) r "
   "FROM lineitem) GROUP BY 1, 2")
op("spread_running_totals", lambda s, d: ordering.running_totals(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [], ["o_orderkey"],
                                                                 {"running": "o_totalprice"}, 0).select("o_orderkey", "running"),
   f"SELECT o_orderkey, {R('sum(o_totalprice) OVER (ORDER BY o_orderkey)', 2)} running FROM orders", digits=2)
_GAPS = "CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderkey % 3 <> 0 AND o_orderkey > 2000 THEN o_totalprice END AS v"
_GAPS_SQL = f"(SELECT *, {_GAPS} FROM orders)"
op("spread_quantiles_with_nulls", lambda s, d: ordering.exact_quantiles(table(s, d, "orders").selectExpr("*", _GAPS), ["o_orderpriority"], {"median": ("v", .5), "p90": ("v", .9)},
                                                                       with_count=True, one_task_rows=0),
   f"SELECT o_orderpriority, {R('median(v)', 4)} AS median, {R('quantile_cont(v, 0.9)', 4)} p90, count(v) n_median, count(v) n_p90 FROM {_GAPS_SQL} GROUP BY 1")
op("spread_running_totals_with_nulls", lambda s, d: ordering.running_totals(table(s, d, "orders").selectExpr("*", _GAPS).select("o_orderpriority", "o_orderkey", "v"), ["o_orderpriority"],
                                                                           ["o_orderkey"], {"running": "v"}, 0).select("o_orderkey", "running"),
   f"SELECT o_orderkey, {R('sum(v) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)', 2)} running FROM {_GAPS_SQL}", digits=2)
op("sample_rows", lambda s, d: D.sample_rows(table(s, d, "part"), "p_partkey", 100).select("p_partkey"),
   "SELECT p_partkey FROM part ORDER BY md5(p_partkey || '|42'), p_partkey LIMIT 100")
op("sample_per_group", lambda s, d: D.sample_rows(table(s, d, "part"), "p_partkey", 20, group=["p_brand"]).select("p_brand", "p_partkey"),
   "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey || '|42'), p_partkey) r FROM part) WHERE r <= 20")
op("large_sample_per_group", lambda s, d: D.sample_rows(table(s, d, "orders"), "o_orderkey", 1500, group=["o_orderstatus"]).select("o_orderstatus", "o_orderkey"),
   "SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || '|42'), o_orderkey) r FROM orders) WHERE r <= 1500")
op("sample_values", lambda s, d: profiling.sample_values(raw(s, d, "listings"), ["name", "price", "license"]))
op("dedupe_rows", lambda s, d: silver(s, d, "listings").groupBy("host_id", "city").agg(F.min("id").alias("id")),
   "SELECT host_id, city, min(id) id FROM s_listings GROUP BY 1, 2")
op("sorted_nulls_last", lambda s, d: ordering.positions(silver(s, d, "listings").select("city", "id", "review_scores_rating"), [],
                                                       [F.asc_nulls_last("review_scores_rating"), F.asc_nulls_last("id"), F.asc_nulls_last("city")]),
   f"SELECT city, id, {R('review_scores_rating', 4)} review_scores_rating, row_number() OVER (ORDER BY review_scores_rating NULLS LAST, id NULLS LAST, city NULLS LAST) AS position FROM s_listings")

# ---- unions ---------------------------------------------------------------------------------------------
op("union_dates", lambda s, d: table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).unionAll(
    table(s, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))).unionAll(table(s, d, "events").select(F.col("ts").cast("date").alias("d")))
    .agg(F.min("d").alias("first"), F.max("d").alias("last"), rows().alias("n")),
   "SELECT min(d) AS first, max(d) AS last, count(*) n FROM (SELECT o_orderdate::DATE d FROM orders UNION ALL SELECT l_shipdate::DATE FROM lineitem UNION ALL SELECT ts::DATE FROM events)")
op("date_series", lambda s, d: readers.date_series(table(s, d, "orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b")), "a", "b"),
   "SELECT unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(o_orderdate)::DATE FROM orders), INTERVAL 1 DAY))::DATE full_date")


def _holders(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
                                       F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    p = table(s, d, "supplier").select(F.col("s_suppkey").cast("int").alias("key"), F.col("s_name").alias("name"),
                                       F.bround("s_acctbal", 0).cast("int").alias("balance"), F.col("s_nationkey").cast("string").alias("nation"))
    return c, p


op("unify_schemas", lambda s, d: enrich.unify(list(_holders(s, d))),
   f"SELECT {R('c_acctbal', 4)} balance, c_custkey AS key, c_name AS name, c_nationkey::VARCHAR nation, c_mktsegment segment FROM customer UNION ALL "
   "SELECT round_even(s_acctbal, 0)::DOUBLE, s_suppkey, s_name, s_nationkey::VARCHAR, NULL FROM supplier")
op("unify_cities", lambda s, d: enrich.unify([wh(s, d).gold.filter(F.col("city") == c).drop(*x) for c, x in (
    ("amsterdam", ["license"]), ("new_york_city", ["beds", "neighbourhood_group"]), ("barcelona", []))]).groupBy("city").agg(
    rows().alias("n"), F.count("license").alias("licenses"), F.count("beds").alias("beds"), F.sum("price_usd").alias("usd")),
   f"SELECT city, count(*) n, if(city = 'amsterdam', 0, count(license)) licenses, if(city = 'new_york_city', 0, count(beds)) beds, {R('sum(price_usd)', 2)} usd FROM gold GROUP BY 1", digits=2)
op("distinct_rows", lambda s, d: silver(s, d, "listings").select("city", "neighbourhood_cleansed", "room_type").distinct(),
   "SELECT DISTINCT city, neighbourhood_cleansed, room_type FROM s_listings")


def _by_city(s, d):
    g = silver(s, d, "listings")
    return {"amsterdam": g.filter("city = 'amsterdam'").select("id", "price", "license", "city"),
            "barcelona": g.filter("city = 'barcelona'").select("id", F.col("price").cast("string").alias("price"), "beds", "city"),
            "new_york_city": g.filter("city = 'new_york_city'").select("id", "price", "beds", "city")}


_HARM = """SELECT 'listings' file_type, * FROM (VALUES ('id', 'amsterdam,barcelona,new_york_city', true, true), ('price', 'amsterdam,barcelona,new_york_city', true, false),
 ('license', 'amsterdam', false, true), ('beds', 'barcelona,new_york_city', false, true), ('city', 'amsterdam,barcelona,new_york_city', true, true)) t(column_name, present_in, common, consistent_type)"""
_NULLS = {"nl": " UNION ALL ".join(f"SELECT '{c}' cname, {R(f'(count(*) - count({c})) * 100e0 / count(*)', 2)} pct FROM s_listings WHERE city = '{t}'"
                                   for t, cs in (("amsterdam", ("id", "price", "license", "city")), ("barcelona", ("id", "price", "beds", "city")), ("new_york_city", ("id", "price", "beds", "city"))) for c in cs)}
op("schema_comparison", lambda s, d: harmonize.harmonization_report({k: {"listings": v} for k, v in _by_city(s, d).items()})["presence"],
   f"SELECT h.*, n.lo min_null_pct, n.hi max_null_pct FROM ({_HARM}) h JOIN (SELECT cname, min(pct) lo, max(pct) hi FROM nl GROUP BY 1) n ON n.cname = h.column_name", _NULLS)
op("schema_comparison_summary", lambda s, d: harmonize.harmonization_report({k: {"listings": v} for k, v in _by_city(s, d).items()})["summary"],
   f"SELECT file_type, count(*) total_unique_columns, count(*) FILTER (common) common_columns, count(*) FILTER (NOT common) city_specific_columns, "
   f"count(*) FILTER (NOT consistent_type) type_inconsistencies FROM ({_HARM}) WHERE column_name IN (SELECT cname FROM nl) GROUP BY 1", _NULLS)
op("file_sizes", lambda s, d: harmonize.file_sizes(readers.list_files(s, d, "*.parquet"), r"([^/]+)\.parquet$"))

# ---- quality -------------------------------------------------------------------------------------------
_RULES = {"l_quantity": [{"check": "not_null"}, {"check": "range", "min": 2, "max": 49}], "l_discount": [{"check": "positive"}],
          "l_returnflag": [{"check": "enum", "values": ["A", "N"]}], "no_such": [{"check": "not_null"}], "l_linestatus": [{"check": "positive"}]}
op("validation_flags", lambda s, d: Q.validation_flags(table(s, d, "lineitem"), _RULES, {"late": F.col("l_shipdate") >= "2001-01-01"}).groupBy(
    "_validation_flags", "_is_valid").agg(rows().alias("n")),
   "SELECT flags _validation_flags, flags = '' _is_valid, count(*) n FROM (SELECT array_to_string(list_filter([CASE WHEN l_discount <= 0 THEN 'l_discount_positive' END, "
   "CASE WHEN l_quantity < 2 OR l_quantity > 49 THEN 'l_quantity_range' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'l_returnflag_enum' END, "
   "CASE WHEN l_shipdate >= DATE '2001-01-01' THEN 'late' END], lambda x: x IS NOT NULL), '|') flags FROM lineitem) GROUP BY 1, 2")


def _rule_sql(kind):
    out = []
    for c, spec in settings.REPORT_RULES[kind].items():
        for rule, arg in spec.items():
            cond = {"not_null": f"count(*) FILTER ({c} IS NULL)", "unique": f"count({c}) - count(DISTINCT {c})"}.get(rule)
            if rule == "regex":
                cond = f"count(*) FILTER (NOT regexp_matches({c}, '{arg}'))"
            elif rule == "enum":
                cond = f"count(*) FILTER ({c} NOT IN ({', '.join(repr(v) for v in arg)}))"
            if cond is None:  # numeric rules do not apply to raw text
                continue
            out.append(f"SELECT '{kind}' file_type, '{c}' column_name, '{rule}' rule, count(*) total_rows, {cond} violations, "
                       f"{R(f'({cond}) * 100e0 / count(*)', 2)} violation_pct, ({cond}) = 0 passed FROM tok_{kind}")
    return " UNION ALL ".join(out)


_KINDS = ["listings", "calendar", "reviews", "neighbourhoods"]
op("column_rules", lambda s, d: D.rows_union([Q.rule_report(raw(s, d, k), settings.REPORT_RULES[k]).select(F.lit(k).alias("file_type"), "*") for k in _KINDS]),
   " UNION ALL ".join(_rule_sql(k) for k in _KINDS))
op("typed_column_rules", lambda s, d: Q.rule_report(silver(s, d, "listings"), {
    "id": {"not_null": True, "unique": True, "positive": True}, "availability_365": {"range": {"min": 0, "max": 300}},
    "room_type": {"enum": ["Entire home/apt", "Private room"]}, "missing_one": {"not_null": True}}, examples=True).select(
    "column_name", "rule", "violations", "passed", F.array_join("unexpected", ",").alias("unexpected")),
   "SELECT 'id' column_name, 'not_null' rule, count(*) - count(id) violations, count(*) = count(id) passed, NULL unexpected FROM s_listings UNION ALL "
   "SELECT 'id', 'unique', count(id) - count(DISTINCT id), count(id) = count(DISTINCT id), NULL FROM s_listings UNION ALL "
   "SELECT 'id', 'positive', count(*) FILTER (id <= 0), count(*) FILTER (id <= 0) = 0, NULL FROM s_listings UNION ALL "
   "SELECT 'availability_365', 'range', count(*) FILTER (availability_365 > 300), count(*) FILTER (availability_365 > 300) = 0, NULL FROM s_listings UNION ALL "
   "SELECT 'room_type', 'enum', count(*) FILTER (room_type NOT IN ('Entire home/apt', 'Private room')), false, 'Hotel room,Shared room' FROM s_listings UNION ALL "
   "SELECT 'missing_one', 'exists', 1, false, NULL")
op("missing_columns", lambda s, d: Q.rule_summary(Q.rule_report(table(s, d, "orders"), {
    "o_orderkey": {"not_null": True, "unique": True}, "o_custkey": {"unique": True}, "o_clerk": {"not_null": True}})),
   "SELECT 3 rules_checked, 1 rules_passed, 2 rules_failed FROM (SELECT count(*) FROM orders)")
op("detect_duplicates", lambda s, d: D.rows_union([Q.duplicate_report(raw(s, d, "calendar"), ["listing_id", "date"]),
                                                   Q.duplicate_report(table(s, d, "events"), ["user_id", "event_type"])]),
   " UNION ALL ".join(f"SELECT '{k}' key_columns, true checked, sum(n)::BIGINT total_rows, count(*) unique_keys, count(*) FILTER (n > 1) duplicate_keys, "
                      f"coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT duplicate_rows FROM (SELECT count(*) n FROM {t} GROUP BY {k})"
                      for k, t in (("listing_id,date", "tok_calendar"), ("user_id,event_type", "events"))))
op("worst_duplicates", lambda s, d: Q.worst_duplicates(raw(s, d, "calendar"), ["listing_id", "date"]),
   "SELECT listing_id, date, count(*) copies FROM tok_calendar GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 5")
op("detect_artifacts", lambda s, d: D.rows_union([Q.artifact_report(table(s, d, t)) for t in ("pages", "documents", "conversations")]),
   " UNION ALL ".join(f"SELECT '{c}' column_name, count(*) FILTER (regexp_matches({c}, '{settings.HTML_TAG_PATTERN}')) html_tags, "
                      f"count(*) FILTER (regexp_matches({c}, '{settings.MOJIBAKE_PATTERN}')) encoding_artifacts FROM {t}"
                      for t, cs in (("pages", ("url", "html")), ("documents", ("text", "lang", "source")), ("conversations", ("role", "text"))) for c in cs))


def _comp_sql(src, cols):
    return " UNION ALL ".join(f"SELECT '{c}' column_name, count(*) - count({c}) null_count, {R(f'(count(*) - count({c})) * 100e0 / count(*)', 2)} null_pct, "
                              f"{R('100e0 - ' + R(f'(count(*) - count({c})) * 100e0 / count(*)', 2), 2)} fill_rate_pct FROM {src}" for c in cols)


from . import testbed  # noqa: E402

op("completeness", lambda s, d: Q.completeness(raw(s, d, "listings")), _comp_sql("tok_listings", testbed.LISTINGS))
op("listings_coverage", lambda s, d: Q.listings_coverage(raw(s, d, "listings")),
   f"SELECT count(DISTINCT neighbourhood_cleansed) unique_neighbourhoods, count(DISTINCT host_id) + max((host_id IS NULL)::INT) unique_hosts, "
   f"{R('count(*)::DOUBLE / (count(DISTINCT host_id) + max((host_id IS NULL)::INT))', 2)} listings_per_host_mean, {R('count(price) * 100e0 / count(*)', 2)} price_fill_rate_pct, "
   f"{R('count(last_review) * 100e0 / count(*)', 2)} listings_with_reviews_pct FROM tok_listings")
op("calendar_coverage", lambda s, d: Q.calendar_coverage(raw(s, d, "calendar")),
   f"SELECT count(DISTINCT listing_id) unique_listings, min(dd) min_date, max(dd) max_date, date_diff('day', min(dd), max(dd))::INT span_days, "
   f"{R('count(*) FILTER (available = chr(116)) * 100e0 / count(available)', 2)} available_pct, {R('count(*) FILTER (available = chr(102)) * 100e0 / count(available)', 2)} unavailable_pct "
   "FROM (SELECT *, TRY_CAST(try_strptime(date, '%Y-%m-%d') AS DATE) dd FROM tok_calendar)")
op("reviews_coverage", lambda s, d: Q.reviews_coverage(raw(s, d, "reviews")),
   "SELECT count(DISTINCT listing_id) unique_listings_reviewed, count(DISTINCT reviewer_id) + max((reviewer_id IS NULL)::INT) unique_reviewers, min(date)::DATE min_date, "
   "max(date)::DATE max_date, date_diff('day', min(date)::DATE, max(date)::DATE)::INT span_days FROM tok_reviews")


def _iqr_sql(src, cols, pre=""):
    return " UNION ALL ".join(
        f"SELECT {pre}'{c}' column_name, {R('q1', 4)} q1, {R('q3', 4)} q3, {R('q3 - q1', 4)} iqr, {R('q1 - 1.5e0 * (q3 - q1)', 4)} lower_bound, {R('q3 + 1.5e0 * (q3 - q1)', 4)} upper_bound, "
        f"count({c}) total_non_null, count(*) FILTER ({c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1)) outlier_count, "
        f"{R(f'count(*) FILTER ({c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1)) * 100e0 / count({c})', 2)} outlier_pct "
        f"FROM {src}, (SELECT quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3 FROM {src}) GROUP BY q1, q3" for c in cols)


op("outliers_iqr", lambda s, d: Q.outliers_iqr(silver(s, d, "listings"), settings.OUTLIER_TARGETS["listings"]),
   _iqr_sql("s_listings", settings.OUTLIER_TARGETS["listings"]))
op("outlier_examples", lambda s, d: Q.outlier_examples(table(s, d, "events"), "value"),
   f"SELECT {R('value', 4)} outlier FROM events WHERE value > (SELECT quantile_cont(value, 0.75) * 2.5e0 - quantile_cont(value, 0.25) * 1.5e0 FROM events) ORDER BY value DESC LIMIT 10")
_SC = {"comp": " UNION ALL ".join(f"SELECT '{k}' f, * FROM ({_comp_sql(f'tok_{k}', testbed.SOURCES[k][0])})" for k in _KINDS)}
op("quality_score", lambda s, d: profiling.quality_report({k: raw(s, d, k) for k in _KINDS})["score"],
   f"SELECT {R('avg(fill)', 1)} overall_score, sum(crit)::BIGINT critical_issues FROM (SELECT f, avg(fill_rate_pct) fill, count(*) FILTER (null_pct > 50 AND column_name IN "
   "('price', 'latitude', 'longitude', 'id')) crit FROM comp GROUP BY f)", _SC)
op("quality_report_outliers", lambda s, d: profiling.quality_report({k: silver(s, d, k) for k in ("listings", "calendar")})["outliers"],
   _iqr_sql("s_listings", settings.OUTLIER_TARGETS["listings"], "'listings' file_name, ") + " UNION ALL "
   + _iqr_sql("s_calendar", settings.OUTLIER_TARGETS["calendar"], "'calendar' file_name, "))
op("schema_rows", lambda s, d: profiling.schema_rows(table(s, d, "orders"), "orders").select("column_name", "dtype", "null_count", "column_count", "schema_hash"),
   "SELECT c.*, n - n null_count, 6 column_count, md5('o_custkey|o_orderdate|o_orderkey|o_orderpriority|o_orderstatus|o_totalprice') schema_hash FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), "
   "('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')) c(column_name, dtype), (SELECT count(*) n FROM orders)")
_NP = ["l_quantity", "l_extendedprice", "l_discount"]
op("numeric_profile", lambda s, d: profiling.numeric_profile(table(s, d, "lineitem"), _NP),
   " UNION ALL ".join(f"SELECT '{c}' column_name, {R(f'min({c})', 4)} AS min, {R(f'max({c})', 4)} AS max, {R(f'avg({c})', 4)} mean, {R(f'stddev_samp({c})', 4)} std, "
                      f"{R(f'quantile_cont({c}, 0.25)', 4)} q25, {R(f'median({c})', 4)} AS median, {R(f'quantile_cont({c}, 0.75)', 4)} q75 FROM lineitem" for c in _NP))
_TP = ["text", "lang", "source"]
op("text_profile", lambda s, d: profiling.text_profile(table(s, d, "documents"), _TP),
   " UNION ALL ".join(f"SELECT '{c}' column_name, min(length({c}))::INT min_length, max(length({c}))::INT max_length, {R(f'avg(length({c}))', 1)} avg_length FROM documents" for c in _TP))
op("date_profile", lambda s, d: profiling.date_profile(table(s, d, "lineitem")),
   "SELECT 'l_shipdate' column_name, min(l_shipdate)::DATE min_date, max(l_shipdate)::DATE max_date, date_diff('day', min(l_shipdate)::DATE, max(l_shipdate)::DATE)::INT date_range_days FROM lineitem")
op("uniqueness", lambda s, d: profiling.uniqueness(silver(s, d, "listings").select("id", "host_id", "name", "review_scores_rating", "license")),
   " UNION ALL ".join(f"SELECT '{c}' column_name, count(DISTINCT {c}) unique_count, {R(f'count(DISTINCT {c}) * 100e0 / count({c})', 2)} unique_pct FROM s_listings"
                      for c in ("id", "host_id", "name", "review_scores_rating", "license")))
op("uniqueness_approximate", lambda s, d: profiling.uniqueness(table(s, d, "lineitem").select("l_partkey", "l_suppkey"), approximate=True))
op("top_values_per_column", lambda s, d: profiling.top_values_per_column(table(s, d, "documents"), ["lang", "source"], 5).drop("place"),
   " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' column_name, {c} AS value, count(*) AS count FROM documents GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)" for c in ("lang", "source")))
op("profile_table", lambda s, d: profiling.profile(silver(s, d, "calendar"), "calendar")["numeric"],
   " UNION ALL ".join(f"SELECT '{c}' column_name, {R(f'min({c})', 4)} AS min, {R(f'max({c})', 4)} AS max, {R(f'avg({c})', 4)} mean, {R(f'stddev_samp({c})', 4)} std, "
                      f"{R(f'quantile_cont({c}, 0.25)', 4)} q25, {R(f'median({c})', 4)} AS median, {R(f'quantile_cont({c}, 0.75)', 4)} q75 FROM s_calendar"
                      for c in ("listing_id", "price", "adjusted_price", "minimum_nights", "maximum_nights")))
_VR = {"vr": " UNION ALL ".join(_rule_sql(k) for k in _KINDS)}
op("validation_report", lambda s, d: profiling.validation_report({k: raw(s, d, k) for k in _KINDS})["summary"].select("file_type", "rules_checked", "rules_passed", "rules_failed", "has_duplicates"),
   "SELECT file_type, count(*) rules_checked, count(*) FILTER (ok) rules_passed, count(*) FILTER (NOT ok) rules_failed, CASE file_type WHEN 'listings' THEN "
   "(SELECT count(*) > count(DISTINCT coalesce(id, '')) FROM tok_listings) WHEN 'calendar' THEN (SELECT count(*) > count(DISTINCT (listing_id, date)) FROM tok_calendar) "
   "WHEN 'reviews' THEN (SELECT count(*) > count(DISTINCT id) FROM tok_reviews) ELSE (SELECT count(*) > count(DISTINCT neighbourhood) FROM tok_neighbourhoods) END has_duplicates "
   "FROM (SELECT file_type, column_name, bool_and(passed) ok FROM vr GROUP BY 1, 2) GROUP BY 1", _VR)

# ---- sources and sinks -------------------------------------------------------------------------------------


def _scratch(s, d, name):
    return f"{wh(s, d).folder}/io/{name}"


def _csv_round_trip(s, d):
    path = _scratch(s, d, "reviews_csv")
    wh(s, d).raw["reviews"].write.mode("overwrite").options(header=True, escape='"', compression="gzip", ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False).csv(path)
    return readers.read_raw(s, path, list(testbed.REVIEWS), spread=8)


op("read_raw", _csv_round_trip, "SELECT * FROM tok_reviews")


def _file_table(s, d):
    stem = F.element_at(F.array(*[F.lit(x) for x in ("listings", "calendar", "reviews", "neighbourhoods", "notes")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    folder = F.concat(F.lit("/data/raw/city_"), F.floor(F.col("p_partkey") / 40).cast("string"))
    end = F.when(F.col("p_partkey") % 3 == 0, F.lit(".csv.gz")).otherwise(F.lit(".csv"))
    return table(s, d, "part").select(F.concat(folder, F.lit("/"), stem, end).alias("path"), F.col("p_size").cast("long").alias("length")).groupBy("path").agg(
        F.max("length").alias("length"))


op("resolve_sources", lambda s, d: readers.resolve_sources(_file_table(s, d)),
   """SELECT folder, base, max_by(path, (gz, path)) AS path, max_by(length, (gz, path)) AS length, if(base = 'notes', 'unknown', base) file_type FROM (
 SELECT folder, base, gz, folder || '/' || base || if(gz = 1, '.csv.gz', '.csv') AS path, max(p_size)::BIGINT AS length FROM (SELECT p_size,
 '/data/raw/city_' || floor(p_partkey / 40)::BIGINT folder, ['listings', 'calendar', 'reviews', 'neighbourhoods', 'notes'][p_partkey % 5 + 1] base,
 (p_partkey % 3 = 0)::INT gz FROM part) GROUP BY ALL) GROUP BY 1, 2""")


def _optional(s, d):
    found = readers.read_optional(s, f"{d}/orders.parquet").select("o_orderstatus")
    absent = readers.read_optional(s, f"{d}/no_such_table.parquet", "o_orderstatus string")
    return found.unionByName(absent).groupBy("o_orderstatus").agg(rows().alias("n"))


op("read_optional", _optional, "SELECT o_orderstatus, count(*) n FROM orders GROUP BY 1")


def _union_scan(s, d):
    base = _scratch(s, d, "union")
    g = silver(s, d, "listings")
    paths = []
    for city, cols in (("amsterdam", ["id", "price"]), ("barcelona", ["id", "price", "license"]), ("new_york_city", ["id", "price"])):
        paths.append(sinks.write_table(g.filter(F.col("city") == city).select(*cols), f"{base}/staging/{city}/listings.parquet"))
    return readers.scan_union_by_name(s, paths, r"staging/([^/]+)/").select("city", "id", "price", "license")


op("scan_union_by_name", _union_scan, "SELECT city, id, price, if(city = 'barcelona', license, NULL) license FROM s_listings")


def _split_sink(s, d):
    base, flagged = _scratch(s, d, "split"), wh(s, d).flagged["listings"]
    sinks.write_split(flagged, base, "listings", by=["city"])
    good, bad = (sinks.read_split(s, base, "listings", flagged.schema, v) for v in (True, False))
    return good.select("city", F.lit("valid").alias("part")).unionAll(bad.select("city", F.lit("rejected").alias("part"))).groupBy("city", "part").agg(rows().alias("n"))


op("split_sink", _split_sink, "SELECT city, if(flags = '', 'valid', 'rejected') AS part, count(*) n FROM flagged_listings GROUP BY 1, 2")
op("overwrite_sink", lambda s, d: s.read.parquet(sinks.write_table(wh(s, d).gold.select("city", "id", "price_usd"), _scratch(s, d, "over"), ["city"])).groupBy("city").agg(
    rows().alias("n"), F.sum("price_usd").alias("usd")), f"SELECT city, count(*) n, {R('sum(price_usd)', 2)} usd FROM gold GROUP BY 1", digits=2)
op("report_sink", lambda s, d: s.read.schema("city string, listings_count long, calendar_coverage_pct double").json(
    sinks.write_report(enrich.join_coverage(wh(s, d).gold, ["city"]), _scratch(s, d, "report"))),
   f"SELECT city, count(*) listings_count, {R('count(total_days) * 100e0 / count(*)', 1)} calendar_coverage_pct FROM gold GROUP BY 1")
op("read_master", lambda s, d: readers.read_master(s, f"{wh(s, d).folder}/gold/listings", "barcelona").groupBy("room_type").agg(rows().alias("n"))
   if wh(s, d).gold is not None else None, "SELECT room_type, count(*) n FROM gold WHERE city = 'barcelona' GROUP BY 1")


def _geojson(s, d):
    path = _scratch(s, d, "geo")
    n = silver(s, d, "neighbourhoods")
    # one document per city, its areas are a fixed short list
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("neighbourhood", "neighbourhood_group").alias("properties"),
                       F.struct(F.lit("Point").alias("type"), F.array(F.lit(4.9), F.lit(52.4)).alias("coordinates")).alias("geometry"))
    docs = n.groupBy("city").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    docs.repartition(3, "city").write.mode("overwrite").partitionBy("city").text(path)
    return readers.read_geojson(s, path).select("neighbourhood", "neighbourhood_group", F.col("geometry.type").alias("shape"))


op("read_geojson", _geojson, "SELECT neighbourhood, neighbourhood_group, 'Point' shape FROM s_neighbourhoods")
op("row_counts", lambda s, d: readers.row_counts({t: table(s, d, t) for t in ("part", "orders", "lineitem", "customer")}),
   " UNION ALL ".join(f"SELECT '{t}' table_name, count(*) row_count FROM {t}" for t in ("part", "orders", "lineitem", "customer")))


def _no_events(s, d):
    from staylens.operators import star
    built = star.build_star(s, wh(s, d).gold, None, None)
    return star.table_counts({k: v for k, v in built.items() if k.startswith("fact") or k == "dim_reviewer"})


op("empty_optional_tables", _no_events, "SELECT 'fact_listing_snapshot' table_name, count(*) row_count FROM gold WHERE id IS NOT NULL UNION ALL "
   "SELECT t, 0 FROM (VALUES ('fact_calendar'), ('fact_review'), ('dim_reviewer')) v(t)")

# ---- ledger ------------------------------------------------------------------------------------------------


def _events(s, d):
    c = F.col("o_custkey").cast("string")
    fid = F.concat(F.lit("file-"), (F.col("o_custkey") % 50).cast("string"))
    # one event per run and moment, so the last event is well defined
    o = table(s, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.col("o_orderkey")).alias("o"))
    return o.select(F.concat(F.lit("run-"), c).alias("run_id"), F.concat(F.lit("city-"), (F.col("o_custkey") % 7).cast("string")).alias("city"),
                    F.concat(F.lit("stage-"), (F.col("o_custkey") % 3).cast("string")).alias("stage"), fid.alias("source_file"), F.md5(fid).alias("source_hash"),
                    F.col("o_orderdate").alias("event_at"),
                    F.when(F.col("o.o_orderstatus") == "P", "RUNNING").when(F.col("o.o_orderstatus") == "F", "FAILED").otherwise("SUCCESS").alias("status"),
                    F.col("o.o_orderkey").alias("rows_input"), F.col("o.o_orderkey").alias("rows_output"), F.lit(0).cast("long").alias("rows_rejected"),
                    F.lit(None).cast("string").alias("error_message"))


_EVS = {"ev": """SELECT 'run-' || o_custkey run_id, 'city-' || (o_custkey % 7) city, 'stage-' || (o_custkey % 3) stage, 'file-' || (o_custkey % 50) source_file,
 o_orderdate event_at, CASE st WHEN 'P' THEN 'RUNNING' WHEN 'F' THEN 'FAILED' ELSE 'SUCCESS' END status, k rows_input FROM (SELECT o_custkey, o_orderdate, max(o_orderkey) k,
 max_by(o_orderstatus, o_orderkey) st FROM orders GROUP BY 1, 2)""",
        "state": "SELECT run_id, max_by(city, event_at) city, max_by(stage, event_at) stage, max_by(source_file, event_at) source_file, min(event_at) started_at, "
                 "max(event_at) FILTER (status <> 'RUNNING') completed_at, max_by(status, event_at) status, max_by(rows_input, event_at) rows_input FROM ev GROUP BY 1"}
op("run_states", lambda s, d: ledger.latest_state(_events(s, d)).select("run_id", "city", "stage", "status", F.col("started_at").cast("string").alias("started_at"),
                                                                        F.col("completed_at").cast("string").alias("completed_at"), "rows_input"),
   "SELECT run_id, city, stage, status, started_at::VARCHAR started_at, completed_at::VARCHAR completed_at, rows_input FROM state", _EVS)
op("recent_runs", lambda s, d: ledger.recent_runs(_events(s, d), city="city-3", limit=20).select("run_id", "status", F.col("started_at").cast("string").alias("started_at")),
   "SELECT run_id, status, started_at::VARCHAR started_at FROM state WHERE city = 'city-3' ORDER BY state.started_at DESC, run_id LIMIT 20", _EVS)


def _manifest(s, d):
    fid = F.concat(F.lit("file-"), (F.col("c_custkey") % 60).cast("string"))
    return table(s, d, "customer").select(F.concat(F.lit("city-"), (F.col("c_custkey") % 7).cast("string")).alias("city"),
                                          F.concat(F.lit("stage-"), (F.col("c_custkey") % 3).cast("string")).alias("stage"), fid.alias("source_file"),
                                          F.md5(fid).alias("source_hash")).distinct()


op("skip_processed", lambda s, d: ledger.unprocessed(_manifest(s, d), _events(s, d)).select("city", "stage", "source_file"),
   "SELECT DISTINCT 'city-' || (c_custkey % 7) city, 'stage-' || (c_custkey % 3) stage, 'file-' || (c_custkey % 60) source_file FROM customer "
   "EXCEPT SELECT city, stage, source_file FROM state WHERE status = 'SUCCESS'", _EVS)
op("composite_hash", lambda s, d: ledger.composite_hash(table(s, d, "documents").select(
    F.concat(F.lit("/raw/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.md5("text").alias("file_hash"), "source"), ["source"]),
   "SELECT source, md5(string_agg(b || d, '' ORDER BY b || d)) source_hash, sum(n)::BIGINT files FROM (SELECT source, substr(md5(p), 1, 3) b, md5(string_agg(p || h, '' ORDER BY p || h)) d, count(*) n "
   "FROM (SELECT source, '/raw/' || lpad(doc_id::VARCHAR, 9, '0') p, md5(text) h FROM documents) GROUP BY 1, 2) GROUP BY 1")


def _hashed_files(s, d):
    """Customers as lines, one text file for each market segment."""
    path = _scratch(s, d, "segments")
    lines = table(s, d, "customer").select("c_mktsegment", F.concat_ws("|", "c_custkey", "c_name").alias("value"))
    lines.repartition("c_mktsegment").write.mode("overwrite").partitionBy("c_mktsegment").text(path)
    return ledger.file_hashes(s, path).select(F.regexp_extract("path", "c_mktsegment=([^/]+)", 1).alias("segment"), "length", "file_hash")


op("file_hashes", _hashed_files,
   "SELECT c_mktsegment segment, sum(octet_length(encode(v)) + 1)::BIGINT length, md5(count(*) || '|' || sum(('0x' || substr(md5(v), 1, 15))::BIGINT::HUGEINT) || '|' || "
   "sum(('0x' || substr(md5(v), 16, 15))::BIGINT::HUGEINT)) file_hash FROM (SELECT c_mktsegment, c_custkey || '|' || c_name v FROM customer) GROUP BY 1")


def _history(s, d):
    cols = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("id"), F.lit("price"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("price"), F.lit("id"))).otherwise(
        F.array(F.lit("id"), F.lit("beds")))
    return table(s, d, "orders").select(F.concat(F.lit("t"), (F.col("o_custkey") % 20).cast("string")).alias("object_name"), F.col("o_orderkey").cast("string").alias("schema_id"),
                                        P.schema_hash_column(cols).alias("schema_hash"), F.to_json(cols).alias("columns_json"),
                                        F.timestamp_seconds(F.col("o_orderkey") + 1_000_000).alias("captured_at"))


op("schema_drift", lambda s, d: ledger.schema_drift(_history(s, d)).groupBy("object_name", "changed", "added", "removed").agg(rows().alias("n")),
   """SELECT object_name, coalesce(h <> ph, false) changed, CASE WHEN ph IS NULL THEN NULL ELSE array_to_string(list_sort(list_filter(c, lambda x: NOT list_contains(pc, x))), ',') END added,
 CASE WHEN ph IS NULL THEN NULL ELSE array_to_string(list_sort(list_filter(pc, lambda x: NOT list_contains(c, x))), ',') END removed, count(*) n FROM (
 SELECT object_name, c, h, lag(c) OVER w pc, lag(h) OVER w ph FROM (SELECT 't' || (o_custkey % 20) object_name, o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN ['id', 'beds'] ELSE ['id', 'price'] END c,
 CASE o_orderkey % 3 WHEN 2 THEN 'x' ELSE 'y' END h FROM orders) WINDOW w AS (PARTITION BY object_name ORDER BY o_orderkey)) GROUP BY ALL""")


def _ledger_run(s, d):
    import uuid
    led = ledger.Ledger(s, _scratch(s, d, f"ledger-{uuid.uuid4().hex[:8]}"))
    n = silver(s, d, "listings").count()
    ledger.run_stages(led, "amsterdam", [("clean", "listings.csv", "h1", lambda: (n, n, 0)), ("enrich", "listings", "h2", lambda: 1 / 0),
                                         ("model", "gold", "h3", lambda: (1, 1, 0))])
    ledger.run_stages(led, "amsterdam", [("clean", "listings.csv", "h1", lambda: (n, n, 0))])
    run = led.recent(stage="clean").first().run_id
    led.record_lineage(run, "silver_listings", ["listings.csv"], ["clean", "flag"])
    lin = led.lineage("silver_listings").groupBy("run_id").agg(rows().alias("lineage_rows"))
    return led.recent().join(lin, "run_id", "left").select("city", "stage", "status", "rows_input", "lineage_rows")


op("run_ledger", _ledger_run, "SELECT 'amsterdam' city, 'clean' stage, 'SUCCESS' status, count(*) rows_input, 1 lineage_rows FROM s_listings UNION ALL "
   "SELECT 'amsterdam', 'enrich', 'FAILED', NULL, NULL")


def _stream(s, d):
    import uuid
    from staylens.streaming import ingest
    base = _scratch(s, d, f"stream-{uuid.uuid4().hex[:8]}")
    raw_reviews = wh(s, d).raw["reviews"]
    for i, part in enumerate((raw_reviews.filter("city = 'barcelona'"), raw_reviews.filter("city <> 'barcelona'"))):
        part.write.mode("append").option("header", True).option("escape", '"').csv(f"{base}/in")
        ingest.ingest(ingest.raw_stream(s, f"{base}/in", list(testbed.REVIEWS)), "reviews", f"{base}/out", f"{base}/state")
    return ingest.ingested(s, f"{base}/out", "reviews")


op("stream_ingest", _stream, "SELECT * FROM s_reviews")


def _growing(s, d):
    import uuid
    from staylens.operators.growing import GrowingProfile
    base = _scratch(s, d, f"growing-{uuid.uuid4().hex[:8]}")
    kept = GrowingProfile(s, f"{base}/state", ledger.Ledger(s, f"{base}/ledger"), "lineitem")
    lines = table(s, d, "lineitem").select("l_partkey", "l_extendedprice", "l_returnflag")
    for flag in ("N", "A", "R", "N"):  # one delivery each, the first one twice
        kept.add(lines.filter(F.col("l_returnflag") == flag), f"lines-{flag}", flag)
    return kept.report()


op("growing_profile", lambda s, d: _growing(s, d).select("column_name", "row_count", "null_count", "min", "max", "mean"),
   " UNION ALL ".join(f"SELECT '{c}' column_name, count(*) row_count, count(*) - count({c}) null_count, {R(f'min({n})', 4)} AS min, {R(f'max({n})', 4)} AS max, {R(f'avg({n})', 4)} mean "
                      "FROM lineitem WHERE l_returnflag IN ('N', 'A', 'R')"
                      for c, n in (("l_partkey", "l_partkey"), ("l_extendedprice", "l_extendedprice"), ("l_returnflag", "CAST(NULL AS DOUBLE)"))))
op("growing_profile_sketches", lambda s, d: _growing(s, d).select("column_name", "unique_count", "unique_pct", "q25", "median", "q75"))
