"""DuckDB statements for the layers of the test bed, written independently of the Spark code.

``statement(sql)`` prefixes a query with the common table expressions it mentions.
"""

import re

from staylens import settings

from . import testbed

GUARD = "0.500001e0"


def R(x: str, digits: int = 0) -> str:
    """Rounding that ignores noise in the last bits, as in the Spark code."""
    p = f"1e{digits}"
    return f"(sign(({x})::DOUBLE)*floor(abs(({x})::DOUBLE)*{p}+{GUARD})/{p}+0e0)"


def NORM_SF(z: str) -> str:
    """Upper normal tail by Simpson's rule on 2,000 steps (the engine has no error function)."""
    w = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return (f"(0.5e0 - list_sum(list_transform(range(0, 2001), lambda i: ({w}) * exp(-pow(({z}) * i / 2000e0, 2) / 2))) "
            f"* ({z}) / 6000e0 / sqrt(2 * pi()))")


def _token(c):
    return f"CASE WHEN {c} IN ('','N/A','NA') THEN NULL ELSE {c} END"


def _price(c):
    return f"TRY_CAST(trim(regexp_replace({c}, '[$€£,]', '', 'g')) AS DOUBLE)"


def _flag(c):
    return f"CASE {c} WHEN 't' THEN true WHEN 'f' THEN false END"


def _date(c):
    return f"TRY_CAST(try_strptime({c}, '%Y-%m-%d') AS DATE)"


def _pct(c):
    return f"TRY_CAST(trim(replace({c}, '%', '')) AS DOUBLE)/100"


def _tidy(c):
    return f"regexp_replace(trim({c}), '\\s{{2,}}', ' ', 'g')"


def _html(c):
    x = f"regexp_replace({c}, '<[^>]+>', '', 'g')"
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim({x})"


INTS = ["host_listings_count", "host_total_listings_count", "calculated_host_listings_count", "accommodates",
        "minimum_nights", "maximum_nights", "availability_30", "availability_60", "availability_90",
        "availability_365", "number_of_reviews", "number_of_reviews_ltm"]
BOOLS = ["host_is_superhost", "host_has_profile_pic", "host_identity_verified", "instant_bookable", "has_availability"]
DATES = ["host_since", "first_review", "last_review", "last_scraped"]
DOUBLES = ["latitude", "longitude", "review_scores_rating", *settings.SUB_SCORES, "reviews_per_month"]


def _typed_listings():
    done = {"id": "TRY_CAST(id AS BIGINT)", "host_id": "TRY_CAST(host_id AS BIGINT)", "price": _price("price")}
    done.update({c: f"TRY_CAST({c} AS INTEGER)" for c in INTS + ["bedrooms", "beds"]})
    done.update({c: _flag(c) for c in BOOLS})
    done.update({c: _date(c) for c in DATES})
    done.update({c: f"TRY_CAST({c} AS DOUBLE)" for c in DOUBLES})
    done.update({c: _pct(c) for c in ("host_response_rate", "host_acceptance_rate")})
    done.update({c: _tidy(c) for c in ("property_type", "neighbourhood_cleansed", "neighbourhood_group_cleansed")})
    done["name"] = "coalesce(name, 'Untitled')"
    done["host_name"] = "coalesce(host_name, 'Unknown')"
    done["neighbourhood_group_cleansed"] = f"coalesce({_tidy('neighbourhood_group_cleansed')}, 'Unknown')"
    cols = [f"{done.get(c, c)} AS {c}" for c in testbed.LISTINGS]
    cols += ["coalesce(TRY_CAST(nullif(regexp_extract(bathrooms_text, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE), "
             "CASE WHEN lower(bathrooms_text) LIKE '%half%' THEN 0.5 END) AS bathrooms",
             "lower(bathrooms_text) LIKE '%shared%' AS bathrooms_shared",
             "CASE WHEN length(amenities) > 2 THEN len(regexp_extract_all(amenities, '\",\"')) + 1 ELSE 0 END AS amenity_count",
             "CASE WHEN length(host_verifications) > 2 THEN len(regexp_extract_all(host_verifications, '''[^'']+''')) "
             "ELSE 0 END AS host_verification_count"]
    return "SELECT " + ", ".join(cols) + " FROM tok_listings"


def _tok(kind):
    cols, _ = testbed.SOURCES[kind]
    return "SELECT " + ", ".join(f"{_token(c)} AS {c}" for c in cols) + f" FROM raw_{kind}"


ROOMS = ", ".join(f"'{r}'" for r in settings.ROOM_TYPES)
LISTING_FLAGS = """array_to_string(list_filter([
 CASE WHEN accommodates <= 0 THEN 'accommodates_positive' END,
 CASE WHEN latitude IS NULL THEN 'latitude_not_null' END,
 CASE WHEN latitude < -90 OR latitude > 90 THEN 'latitude_range' END,
 CASE WHEN longitude IS NULL THEN 'longitude_not_null' END,
 CASE WHEN longitude < -180 OR longitude > 180 THEN 'longitude_range' END,
 CASE WHEN price IS NULL THEN 'price_not_null' END,
 CASE WHEN price <= 0 THEN 'price_positive' END,
 CASE WHEN room_type NOT IN (%s) THEN 'room_type_enum' END,
 CASE WHEN room_type IS NULL THEN 'room_type_not_null' END], lambda x: x IS NOT NULL), '|')""" % ROOMS
EVENT_FLAGS = """array_to_string(list_filter([
 CASE WHEN date IS NULL THEN 'date_not_null' END,
 CASE WHEN listing_id IS NULL THEN 'listing_id_not_null' END,
 CASE WHEN listing_id <= 0 THEN 'listing_id_positive' END], lambda x: x IS NOT NULL), '|')"""

SCRAPE = ("CASE l.city WHEN 'amsterdam' THEN DATE '2025-09-11' WHEN 'new_york_city' THEN DATE '2026-04-14' "
          "ELSE DATE '2026-03-21' END")
RATE = "CASE WHEN l.city = 'new_york_city' THEN 1e0 ELSE 1.08e0 END"
CTES: dict[str, str] = {}
for _k in testbed.SOURCES:
    CTES[f"raw_{_k}"] = testbed.raw_sql(_k)
    CTES[f"tok_{_k}"] = _tok(_k)
CTES.update({
    "typed_listings": _typed_listings(),
    "meds": "SELECT city, room_type, accommodates, median(bedrooms) mb, median(beds) me, median(bathrooms) ma "
            "FROM typed_listings GROUP BY ALL",
    "filled_listings": """SELECT t.* REPLACE (coalesce(t.bedrooms::DOUBLE, m.mb) AS bedrooms,
        coalesce(t.beds::DOUBLE, m.me) AS beds, coalesce(t.bathrooms, m.ma) AS bathrooms),
        t.bedrooms IS NULL AS bedrooms_imputed, t.beds IS NULL AS beds_imputed, t.bathrooms IS NULL AS bathrooms_imputed
        FROM typed_listings t LEFT JOIN meds m ON t.city = m.city AND t.room_type = m.room_type
        AND t.accommodates = m.accommodates""",
    "flagged_listings": f"SELECT *, {LISTING_FLAGS} AS flags FROM filled_listings",
    "typed_calendar": f"SELECT city, TRY_CAST(listing_id AS BIGINT) listing_id, {_date('date')} AS date, "
                      f"{_flag('available')} AS available, {_price('price')} AS price, "
                      f"{_price('adjusted_price')} AS adjusted_price, TRY_CAST(minimum_nights AS INTEGER) minimum_nights, "
                      "TRY_CAST(maximum_nights AS INTEGER) maximum_nights FROM tok_calendar",
    "flagged_calendar": f"SELECT *, {EVENT_FLAGS} AS flags FROM typed_calendar",
    "typed_reviews": f"SELECT city, TRY_CAST(id AS BIGINT) id, TRY_CAST(listing_id AS BIGINT) listing_id, "
                     f"{_date('date')} AS date, TRY_CAST(reviewer_id AS BIGINT) reviewer_id, reviewer_name, "
                     f"{_html('comments')} AS comments FROM tok_reviews",
    "flagged_reviews": f"SELECT *, {EVENT_FLAGS} AS flags FROM typed_reviews",
    "flagged_neighbourhoods": f"SELECT city, {_tidy('neighbourhood')} neighbourhood, "
                              f"{_tidy('neighbourhood_group')} neighbourhood_group, "
                              "CASE WHEN neighbourhood IS NULL THEN 'neighbourhood_not_null' ELSE '' END AS flags "
                              "FROM tok_neighbourhoods",
    "s_listings": "SELECT * EXCLUDE (flags, bedrooms_imputed, beds_imputed, bathrooms_imputed) FROM flagged_listings WHERE flags = ''",
    "s_calendar": "SELECT * EXCLUDE (flags) FROM flagged_calendar WHERE flags = ''",
    "s_reviews": "SELECT * EXCLUDE (flags) FROM flagged_reviews WHERE flags = ''",
    "s_neighbourhoods": "SELECT * EXCLUDE (flags) FROM flagged_neighbourhoods WHERE flags = ''",
    "cal_agg": f"""SELECT *, {R('occupancy_rate_pct / 100 * avg_booked_price * 30', 2)} AS estimated_monthly_revenue FROM (
        SELECT city, listing_id, count(*) total_days, coalesce(sum(available::INT), 0)::BIGINT days_available,
        coalesce(sum((NOT available)::INT), 0)::BIGINT days_booked,
        avg(price) FILTER (available) avg_asking_price, median(price) FILTER (available) median_asking_price,
        coalesce(sum(price) FILTER (NOT available), 0) estimated_annual_revenue,
        avg(price) FILTER (NOT available) avg_booked_price,
        avg(adjusted_price) FILTER (available) avg_adjusted_asking_price,
        avg(minimum_nights) avg_min_nights_cal, avg(maximum_nights) avg_max_nights_cal,
        {R('coalesce(sum((NOT available)::INT), 0) * 100e0 / count(*)', 2)} AS occupancy_rate_pct
        FROM s_calendar GROUP BY city, listing_id)""",
    "rev_agg": f"""SELECT city, listing_id, count(*) review_count_computed, min(date) first_review_date_computed,
        max(date) last_review_date_computed,
        count(DISTINCT reviewer_id) + max((reviewer_id IS NULL)::INT) AS unique_reviewers,
        {R('avg(length(comments))', 0)} AS avg_comment_length, median(length(comments)) AS median_comment_length
        FROM s_reviews GROUP BY city, listing_id""",
    "area_agg": f"""SELECT a.*, r.neighbourhood_group FROM (
        SELECT city, neighbourhood_cleansed, count(*) neighbourhood_listing_count,
        median(price) neighbourhood_median_price, {R('avg(price)', 2)} AS neighbourhood_mean_price,
        {R('avg(review_scores_rating)', 2)} AS neighbourhood_avg_rating,
        {R('avg(availability_365)', 1)} AS neighbourhood_avg_availability
        FROM s_listings GROUP BY city, neighbourhood_cleansed) a
        LEFT JOIN (SELECT DISTINCT city, neighbourhood, neighbourhood_group FROM s_neighbourhoods) r
        ON a.city = r.city AND a.neighbourhood_cleansed = r.neighbourhood""",
    "gold": f"""SELECT l.*, c.* EXCLUDE (city, listing_id), v.* EXCLUDE (city, listing_id),
        a.* EXCLUDE (city, neighbourhood_cleansed), l.price AS price_local, {SCRAPE} AS scrape_date,
        CASE l.city WHEN 'amsterdam' THEN 'Amsterdam' WHEN 'new_york_city' THEN 'New York City' ELSE 'Barcelona' END AS city_display_name,
        CASE WHEN l.city = 'new_york_city' THEN 'USD' ELSE 'EUR' END AS currency_code,
        {R(f"date_diff('day', l.host_since, {SCRAPE}) / 365.25e0", 2)} AS host_tenure_years,
        CASE WHEN l.first_review IS NOT NULL AND l.number_of_reviews > 0 THEN
          {R(f"l.number_of_reviews / greatest(date_diff('day', l.first_review, {SCRAPE}) / 30.44e0, 1e0)", 2)} END AS review_frequency_monthly,
        CASE WHEN l.bedrooms > 0 THEN {R('l.price / l.bedrooms', 2)} END AS price_per_bedroom,
        CASE WHEN l.accommodates > 0 THEN {R('l.price / l.accommodates', 2)} END AS price_per_person,
        coalesce(l.last_review >= {SCRAPE} - 365, false) OR coalesce(l.availability_365 >= 1, false) AS is_active,
        coalesce(l.calculated_host_listings_count >= 3, false) AS is_professional_host,
        CASE WHEN a.neighbourhood_median_price > 0 THEN {R('l.price / a.neighbourhood_median_price', 3)} END AS price_vs_neighbourhood,
        {R(f'l.price * {RATE}', 2)} AS price_usd,
        {R(f'c.avg_asking_price * {RATE}', 2)} AS avg_asking_price_usd,
        {R(f'c.median_asking_price * {RATE}', 2)} AS median_asking_price_usd,
        {R(f'c.avg_booked_price * {RATE}', 2)} AS avg_booked_price_usd,
        {R(f'c.estimated_monthly_revenue * {RATE}', 2)} AS estimated_monthly_revenue_usd,
        {R(f'c.estimated_annual_revenue * {RATE}', 2)} AS estimated_annual_revenue_usd,
        {R(f'a.neighbourhood_median_price * {RATE}', 2)} AS neighbourhood_median_price_usd,
        {R(f'a.neighbourhood_mean_price * {RATE}', 2)} AS neighbourhood_mean_price_usd
        FROM s_listings l LEFT JOIN cal_agg c ON l.city = c.city AND l.id = c.listing_id
        LEFT JOIN rev_agg v ON l.city = v.city AND l.id = v.listing_id
        LEFT JOIN area_agg a ON l.city = a.city AND l.neighbourhood_cleansed = a.neighbourhood_cleansed""",
    "dim_city": "SELECT * FROM (VALUES (1, 'amsterdam', 'Amsterdam', 'the-netherlands', 'EUR', '€', 'Europe/Amsterdam'), "
                "(2, 'new_york_city', 'New York City', 'united-states', 'USD', '$', 'America/New_York'), "
                "(3, 'barcelona', 'Barcelona', 'spain', 'EUR', '€', 'Europe/Barcelona')) "
                "t(city_key, city_name, display_name, country, currency_code, currency_symbol, timezone)",
    "all_days": "SELECT scrape_date d FROM gold UNION ALL SELECT date FROM s_calendar UNION ALL SELECT date FROM s_reviews",
    "dim_date": """SELECT strftime(d, '%Y%m%d')::INT date_key, d::DATE full_date, year(d)::SMALLINT AS year,
        quarter(d)::TINYINT AS quarter, month(d)::TINYINT AS month, day(d)::TINYINT day_of_month,
        strftime(d, '%w')::TINYINT day_of_week, strftime(d, '%A') day_name, strftime(d, '%B') month_name,
        strftime(d, '%w') IN ('0', '6') is_weekend, strftime(d, '%W')::TINYINT week_of_year
        FROM (SELECT unnest(generate_series((SELECT min(d) FROM all_days), (SELECT max(d) FROM all_days), INTERVAL 1 DAY)) d)""",
    "dim_host": """SELECT row_number() OVER (ORDER BY host_id) host_key, * FROM (
        SELECT host_id, min(host_name) host_name, min(host_since) host_since, min(host_location) host_location,
        min(host_response_time) host_response_time, max(host_response_rate) host_response_rate,
        max(host_acceptance_rate) host_acceptance_rate, bool_or(coalesce(host_is_superhost, false)) host_is_superhost,
        max(coalesce(host_listings_count, calculated_host_listings_count)) host_listings_count,
        max(host_total_listings_count) host_total_listings_count,
        bool_or(coalesce(host_has_profile_pic, false)) host_has_profile_pic,
        bool_or(coalesce(host_identity_verified, false)) host_identity_verified,
        max(host_verification_count) host_verification_count,
        bool_or(coalesce(is_professional_host, false)) is_professional_host, max(host_tenure_years) host_tenure_years
        FROM gold WHERE host_id IS NOT NULL GROUP BY host_id)""",
    "dim_property": """SELECT row_number() OVER (ORDER BY listing_id) property_key, * FROM (
        SELECT id listing_id, min(listing_url) listing_url, min(name) AS name, min(description) description,
        min(property_type) property_type, min(room_type) room_type, max(accommodates) accommodates,
        max(bathrooms) bathrooms, bool_or(coalesce(bathrooms_shared, false)) bathrooms_shared,
        max(bedrooms::INT) bedrooms, max(beds::INT) beds, min(amenities) amenities, max(amenity_count) amenity_count,
        bool_or(coalesce(instant_bookable, false)) instant_bookable, min(license) license
        FROM gold WHERE id IS NOT NULL GROUP BY id)""",
    "dim_neighbourhood": """SELECT row_number() OVER (ORDER BY city, neighbourhood_name) neighbourhood_key, * FROM (
        SELECT city, neighbourhood_cleansed neighbourhood_name,
        min(coalesce(neighbourhood_group, neighbourhood_group_cleansed)) neighbourhood_group,
        max(neighbourhood_listing_count)::INT listing_count, max(neighbourhood_median_price) median_price,
        max(neighbourhood_mean_price) mean_price, max(neighbourhood_avg_rating) avg_rating,
        max(neighbourhood_avg_availability) avg_availability
        FROM gold WHERE neighbourhood_cleansed IS NOT NULL GROUP BY city, neighbourhood_cleansed)""",
    "dim_reviewer": """SELECT row_number() OVER (ORDER BY reviewer_id) reviewer_key, * FROM (
        SELECT reviewer_id, min(reviewer_name) reviewer_name FROM s_reviews
        WHERE reviewer_id IS NOT NULL GROUP BY reviewer_id)""",
    "fact_listing_snapshot": """SELECT row_number() OVER (ORDER BY g.city, g.id) listing_key, g.id listing_id, h.host_key,
        p.property_key, n.neighbourhood_key, c.city_key, d.date_key snapshot_date_key, g.price_local, g.price_usd,
        g.latitude, g.longitude, g.minimum_nights, g.maximum_nights, g.number_of_reviews, g.number_of_reviews_ltm,
        g.review_scores_rating, g.review_scores_accuracy, g.review_scores_cleanliness, g.review_scores_checkin,
        g.review_scores_communication, g.review_scores_location, g.review_scores_value, g.reviews_per_month,
        g.availability_30, g.availability_60, g.availability_90, g.availability_365, g.occupancy_rate_pct,
        g.estimated_annual_revenue, g.estimated_monthly_revenue, g.avg_booked_price, g.price_per_bedroom,
        g.price_per_person, g.price_vs_neighbourhood, g.host_tenure_years, g.is_active, g.is_professional_host
        FROM gold g LEFT JOIN dim_host h ON g.host_id = h.host_id LEFT JOIN dim_property p ON g.id = p.listing_id
        LEFT JOIN dim_neighbourhood n ON g.city = n.city AND g.neighbourhood_cleansed = n.neighbourhood_name
        LEFT JOIN dim_city c ON g.city = c.city_name LEFT JOIN dim_date d ON g.scrape_date = d.full_date
        WHERE g.id IS NOT NULL""",
    "snap_city": "SELECT f.listing_id, f.listing_key, c.city_name city FROM fact_listing_snapshot f JOIN dim_city c USING (city_key)",
    "fact_calendar": f"""SELECT f.listing_key, d.date_key, l.available is_available, l.price price_local,
        {R(f'l.price * {RATE}', 2)} AS price_usd, l.adjusted_price, l.minimum_nights, l.maximum_nights
        FROM s_calendar l LEFT JOIN snap_city f ON l.listing_id = f.listing_id AND l.city = f.city
        LEFT JOIN dim_date d ON l.date = d.full_date""",
    "fact_review": """SELECT r.id review_id, f.listing_key, w.reviewer_key, d.date_key review_date_key,
        length(r.comments)::INT comment_length FROM s_reviews r
        LEFT JOIN snap_city f ON r.listing_id = f.listing_id AND r.city = f.city
        LEFT JOIN dim_reviewer w ON r.reviewer_id = w.reviewer_id LEFT JOIN dim_date d ON r.date = d.full_date""",
})


def _mentions(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql))
    return [n for n in CTES if n in words]


def statement(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` with the CTEs it needs in front, in dependency order."""
    extra = extra or {}
    done: list[str] = []

    def need(text):
        for n in _mentions(text):
            if n not in done:
                need_of = CTES[n]
                need(need_of)
                if n not in done:
                    done.append(n)
    for text in [*extra.values(), sql]:
        need(text)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" if n in ("gold", "s_calendar", "s_reviews", "s_listings")
             else f"{n} AS ({CTES[n]})" for n in done]
    parts += [f"{n} AS ({q})" for n, q in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + sql
