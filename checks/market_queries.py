"""Registered queries: named market and exploration queries over the star tables."""

from staylens.functions import bands
from staylens.plans import explore, market
from staylens.plans.registry import run_sql
from staylens import settings

from .layers import fixed, wh
from .oracle_base import R, statement

ENTRIES: dict[str, tuple] = {}


def named(name, sql=None, digits=4, extra=None, key=None, **params):
    fn = {**market.NAMED, **explore.NAMED}[name]
    ENTRIES[key or name] = (lambda s, d: fixed(fn(wh(s, d).star, **params), digits),
                            statement(sql, extra) if sql else None)


SNAP = "fact_listing_snapshot f"
C, P, H, A = ("JOIN dim_city c USING (city_key)", "JOIN dim_property p USING (property_key)",
              "JOIN dim_host h USING (host_key)", "JOIN dim_neighbourhood n USING (neighbourhood_key)")
named("market_overview", f"""SELECT c.display_name city, n.neighbourhood_name neighbourhood, count(*) listing_count,
 {R('avg(f.price_local)', 2)} avg_price, {R('median(f.price_local)', 2)} median_price,
 {R('avg(f.occupancy_rate_pct)', 1)} avg_occupancy_pct, {R('avg(f.estimated_monthly_revenue)')} avg_monthly_revenue,
 {R('sum(f.estimated_annual_revenue)')} total_annual_revenue FROM {SNAP} {C} {A} GROUP BY ALL""")
named("host_segmentation", f"""SELECT c.display_name city, if(h.is_professional_host, 'Professional', 'Individual') host_type,
 count(DISTINCT h.host_id) host_count, count(*) listing_count, {R('avg(f.price_local)', 2)} avg_price,
 {R('avg(f.review_scores_rating)', 2)} avg_rating, {R('avg(f.occupancy_rate_pct)', 1)} avg_occupancy_pct,
 {R('avg(f.estimated_monthly_revenue)')} avg_monthly_revenue, {R('sum(f.estimated_annual_revenue)')} total_annual_revenue
 FROM {SNAP} {H} {C} GROUP BY 1, 2""")
named("price_positioning", f"""SELECT c.display_name city, p.room_type,
 CASE WHEN price_vs_neighbourhood > 1.2 THEN '{bands.PREMIUM}' WHEN price_vs_neighbourhood >= 0.8 THEN '{bands.MID_RANGE}'
 ELSE '{bands.BUDGET}' END price_segment, count(*) listing_count, {R('avg(f.price_local)', 2)} avg_price,
 {R('avg(f.occupancy_rate_pct)', 1)} avg_occupancy_pct, {R('avg(f.review_scores_rating)', 2)} avg_rating
 FROM {SNAP} {C} {P} WHERE price_vs_neighbourhood IS NOT NULL GROUP BY 1, 2, 3""")
named("seasonal_patterns", f"""SELECT d.year, d.month, d.month_name, count(*) total_days,
 count(*) FILTER (is_available IS NOT true) booked_days, {R('count(*) FILTER (is_available IS NOT true) * 100e0 / count(*)', 1)} occupancy_pct,
 {R('avg(price_local)', 2)} avg_asking_price, {R('avg(price_local) FILTER (NOT is_available)', 2)} avg_booked_price
 FROM fact_calendar JOIN dim_date d USING (date_key) GROUP BY ALL""")
named("supply_analysis", f"""SELECT * FROM (SELECT c.display_name city, property_type, room_type, count(*) listing_count,
 {R('count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY c.display_name)', 1)} pct_of_city_supply,
 {R('avg(p.accommodates)', 1)} avg_capacity, {R('avg(f.price_local)', 2)} avg_price,
 {R('avg(f.availability_365)')} avg_availability_365 FROM {SNAP} {C} {P} GROUP BY 1, 2, 3) WHERE listing_count >= 10""")
named("review_velocity", f"""SELECT d.year, d.month, d.month_name, count(*) review_count, count(*) * 2 estimated_bookings,
 count(DISTINCT listing_key) listings_reviewed, {R('avg(comment_length)')} avg_comment_length
 FROM fact_review r JOIN dim_date d ON d.date_key = r.review_date_key GROUP BY ALL""")
named("regulatory_compliance", f"""SELECT c.display_name city, neighbourhood_name neighbourhood, count(*) total_listings,
 count(*) FILTER (license <> '') with_license, {R("count(*) FILTER (license <> '') * 100e0 / count(*)", 1)} license_pct
 FROM {SNAP} {C} {P} {A} GROUP BY 1, 2""")
named("cross_city_comparison", f"""SELECT display_name city, currency_code, count(*) listing_count, {R('avg(price_local)', 2)} avg_price_local,
 {R('avg(price_usd)', 2)} avg_price_usd, {R('median(price_usd)', 2)} median_price_usd, {R('avg(occupancy_rate_pct)', 1)} avg_occupancy_pct,
 {R('avg(estimated_monthly_revenue)')} avg_monthly_rev_local, {R('avg(review_scores_rating)', 2)} avg_rating,
 {R('avg(number_of_reviews)', 1)} avg_review_count, count(*) FILTER (is_active) active_listings,
 {R('count(*) FILTER (is_active) * 100e0 / count(*)', 1)} active_pct FROM {SNAP} {C} GROUP BY 1, 2""")
_KPI = (f"SELECT count(*) total_listings, {R('avg(price_usd)', 4)} avg_daily_rate_usd, {R('avg(occupancy_rate_pct)', 4)} avg_occupancy_pct, "
        f"{R('count(*) FILTER (is_professional_host) * 100e0 / count(*)', 4)} professional_host_pct FROM {SNAP}")
named("executive_kpis", _KPI)
named("executive_kpis", _KPI + " WHERE city_key = 2", key="executive_kpis_of_city", city_key=2)
named("map_points", f"SELECT latitude, longitude, price_usd, room_type FROM (SELECT {R('f.latitude', 4)} latitude, {R('f.longitude', 4)} longitude, {R('price_usd', 4)} price_usd, room_type FROM {SNAP} {P}) LIMIT 50000")
named("neighbourhood_metrics", f"""SELECT neighbourhood_name, count(*) listing_count, {R('median(price_usd)', 4)} median_price_usd,
 {R('avg(occupancy_rate_pct)', 4)} avg_occupancy_pct, {R('median(estimated_monthly_revenue)', 4)} median_monthly_revenue
 FROM {SNAP} {A} GROUP BY 1 HAVING count(*) > 50 ORDER BY median(price_usd) DESC, 1 LIMIT 20""")
named("room_type_metrics", f"SELECT room_type, count(*) listing_count, {R('median(price_usd)', 4)} median_price_usd FROM {SNAP} {P} GROUP BY 1")
named("valuation_arbitrage", f"""SELECT f.listing_id, name, {R('price_usd', 4)} price_usd, p.bedrooms,
 {R('price_usd / nullif(p.bedrooms, 0)', 2)} price_per_bedroom, {R('review_scores_rating', 4)} review_scores_rating, number_of_reviews,
 {R('estimated_monthly_revenue', 4)} estimated_monthly_revenue, neighbourhood_name FROM {SNAP} {P} {A}
 WHERE review_scores_rating >= 4.8 AND number_of_reviews > 30 AND price_usd < (SELECT median(price_usd) FROM fact_listing_snapshot)
 ORDER BY f.estimated_monthly_revenue DESC NULLS LAST, f.listing_id LIMIT 50""")
named("host_concentration", f"""SELECT if(is_professional_host, 'Professional (2+)', 'Casual (1)') host_segment, count(*) listing_count,
 {R('median(price_usd)', 4)} median_price_usd, {R('avg(occupancy_rate_pct)', 4)} avg_occupancy_pct,
 {R('median(estimated_monthly_revenue)', 4)} median_revenue FROM {SNAP} GROUP BY 1""")
_TREND = (f"SELECT d.full_date AS date, {R('avg(price_usd)', 4)} avg_price, "
          f"{R('100 - count(*) FILTER (is_available) * 100e0 / count(*)', 4)} booked_occupancy_rate FROM fact_calendar JOIN dim_date d USING (date_key)")
named("temporal_trends", _TREND + " GROUP BY 1")
named("temporal_trends", _TREND + " WHERE listing_key IN (SELECT listing_key FROM fact_listing_snapshot WHERE city_key = 3) GROUP BY 1",
      key="temporal_trends_of_city", city_key=3)
SCORED = {"lm": f"""SELECT f.listing_id, name, price_usd, review_scores_rating r, number_of_reviews, occupancy_rate_pct o,
  f.is_professional_host pro, availability_365, neighbourhood_name, avg(price_usd) OVER w ap, avg(occupancy_rate_pct) OVER w ao,
  avg(review_scores_rating) OVER w ar FROM {SNAP} {P} {A} WHERE number_of_reviews > 10 AND price_usd > 10
  WINDOW w AS (PARTITION BY neighbourhood_name)""",
  "sl": f"""SELECT *, {R('r', 2)} rating, {R('o', 1)} occupancy_pct,
  {R('''(least(greatest(10 - price_usd / nullif(ap, 0) * 5, 0), 10) * 0.25e0 + least(greatest((r - 3.5e0) * 6.66e0, 0), 10) * 0.40e0
   + least(greatest(o / 10, 0), 10) * 0.35e0) * 10''', 1)} health_score,
  CASE WHEN price_usd < ap * 0.8e0 AND o > 75 AND r >= 4.8 THEN '{bands.UNDERPRICED}' WHEN price_usd > ap * 1.3e0 AND o < 30 THEN '{bands.OVERPRICED}'
  WHEN r < 4.4 AND number_of_reviews > 20 THEN '{bands.LOW_QUALITY}' WHEN availability_365 > 300 AND o < 15 THEN '{bands.WEAK_CONVERSION}'
  WHEN pro AND r < 4.6 THEN '{bands.PORTFOLIO_RISK}' ELSE '{bands.HEALTHY}' END priority_action FROM lm"""}
_RADAR = (f"SELECT listing_id, name, neighbourhood_name, {R('price_usd', 4)} price_usd, rating, occupancy_pct, health_score, priority_action "
          f"FROM sl WHERE priority_action <> '{bands.HEALTHY}' ORDER BY sl.health_score NULLS LAST, listing_id LIMIT 300")
named("intervention_radar", _RADAR, extra=SCORED)
named("intervention_queue", f"SELECT priority_action, count(*) AS count FROM ({_RADAR}) GROUP BY 1", extra=SCORED)
ENTRIES["area_window_averages"] = (
    lambda s, d: fixed(market.scored_listings(wh(s, d).star).select(
        "listing_id", "hood_avg_price", "hood_avg_occ", "hood_avg_rating", "health_score", "priority_action")),
    statement(f"SELECT listing_id, {R('ap', 4)} hood_avg_price, {R('ao', 4)} hood_avg_occ, {R('ar', 4)} hood_avg_rating, "
              "health_score, priority_action FROM sl", SCORED))
named("neighbourhood_interventions", f"""SELECT neighbourhood_name, total_listings, {R('p')} avg_price, {R('o', 1)} avg_occupancy_pct, {R('r', 2)} avg_rating,
 CASE WHEN o > 65 AND p < m THEN '{bands.ZONE_VALUE}' WHEN o < 35 AND total_listings > 200 THEN '{bands.ZONE_SATURATED}'
 WHEN p > m * 1.5 THEN '{bands.ZONE_PREMIUM}' WHEN r < 4.5 THEN '{bands.ZONE_WEAK}' ELSE '{bands.ZONE_NEUTRAL}' END opportunity_zone
 FROM (SELECT neighbourhood_name, count(f.listing_id) total_listings, avg(price_usd) p, avg(occupancy_rate_pct) o, avg(review_scores_rating) r
 FROM {SNAP} {A} GROUP BY 1), (SELECT avg(price_usd) m FROM fact_listing_snapshot) WHERE total_listings > 20""")
ENTRIES["available_cities"] = (
    lambda s, d: market.available_cities(wh(s, d).star).join(
        market.snapshot(wh(s, d).star).groupBy("city_key").count(), "city_key"),
    statement(f"SELECT city_key, c.display_name, count(*) AS count FROM {SNAP} {C} GROUP BY ALL"))

BASE = {"base": f"""SELECT f.*, c.display_name city, p.name listing_name, p.property_type, p.room_type, p.accommodates, p.bedrooms,
 p.beds, p.bathrooms, p.amenity_count, n.neighbourhood_name, n.neighbourhood_group, h.host_id, h.host_is_superhost,
 h.host_response_rate, h.host_listings_count FROM {SNAP} {C} {P} {A} {H}""",
        "trimmed": "SELECT * FROM base WHERE price_usd <= (SELECT quantile_cont(price_usd, 0.99) FROM base)",
        "hosts": "SELECT city, host_id, max(host_listings_count) host_listings_count FROM base GROUP BY ALL",
        "cal": """SELECT fc.*, d.year, d.month, d.month_name, d.day_name, d.day_of_week, d.is_weekend, c.display_name city,
 coalesce(fc.price_local, f.price_local) price FROM fact_calendar fc JOIN dim_date d USING (date_key)
 JOIN fact_listing_snapshot f USING (listing_key) JOIN dim_city c USING (city_key)""",
        "rev": """SELECT r.*, d.year, d.month, d.month_name, c.display_name city FROM fact_review r
 JOIN dim_date d ON d.date_key = r.review_date_key JOIN fact_listing_snapshot f USING (listing_key)
 JOIN dim_city c USING (city_key) WHERE d.year >= 1997"""}


def explored(name, sql, digits=4, **params):
    used = {}
    words = sql
    for k in ("rev", "cal", "hosts", "trimmed", "base"):
        if k in words:
            used[k] = BASE[k]
            words += BASE[k]
    named(name, sql, digits, {k: used[k] for k in BASE if k in used}, **params)


_B = ["listing_id", "city", "listing_name", "property_type", "room_type", "accommodates", "bedrooms", "beds", "amenity_count",
      "neighbourhood_name", "neighbourhood_group", "host_id", "host_is_superhost", "host_listings_count", "number_of_reviews",
      "availability_365", "is_active", "is_professional_host", "price_usd", "review_scores_rating", "occupancy_rate_pct", "host_tenure_years"]
ENTRIES["listing_base"] = (
    lambda s, d: fixed(explore.listing_base(wh(s, d).star).select(*_B)),
    statement("SELECT " + ", ".join(f"{R(c, 4)} {c}" if c in _B[-4:] else c for c in _B) + " FROM base", {"base": BASE["base"]}))
explored("monthly_availability", "SELECT city, " + ", ".join(
    f"{R(f'count(*) FILTER (is_available AND month = {m}) * 100e0 / nullif(count(*) FILTER (month = {m}), 0)', 1)} month_{m}"
    for m in range(1, 13)) + " FROM cal GROUP BY city")
explored("monthly_pricing", f"""SELECT city, year, month, month_name, {R('avg(price)', 2)} avg_asking_price,
 {R('avg(price) FILTER (NOT is_available)', 2)} avg_booked_price, {R('count(*) FILTER (NOT is_available) * 100e0 / count(*)', 1)} occupancy_pct,
 count(DISTINCT listing_key) listings_active FROM cal WHERE price > 0 GROUP BY ALL""")
explored("weekday_pricing", f"""SELECT city, is_weekend, day_name, {R('avg(price)', 2)} avg_price, {R('median(price)', 2)} median_price,
 count(*) observations FROM cal WHERE price > 0 GROUP BY ALL""")
explored("city_review_velocity", """SELECT city, year, month, month_name, count(*) review_count, count(*) * 2 estimated_bookings,
 count(DISTINCT listing_key) listings_reviewed, make_date(year, month, 1) AS period FROM rev GROUP BY ALL""", since=1997)
explored("review_growth", f"""SELECT city, year, review_count, {R('growth_pct', 4)} growth_pct FROM (SELECT city, year, count(*) review_count,
 (count(*)::DOUBLE / lag(count(*)) OVER (PARTITION BY city ORDER BY year) - 1) * 100 growth_pct FROM rev GROUP BY city, year) WHERE growth_pct IS NOT NULL""", since=1997)


def _five(keys, cols, src):
    return " UNION ALL ".join(
        f"SELECT {keys}, '{c}' AS variable, {R(f'min({c})', 4)} low, {R(f'quantile_cont({c}, 0.25)', 4)} q1, {R(f'median({c})', 4)} AS median, "
        f"{R(f'quantile_cont({c}, 0.75)', 4)} q3, {R(f'max({c})', 4)} high, count({c}) n FROM {src} WHERE {c} IS NOT NULL GROUP BY ALL" for c in cols)


_TEN = ("(SELECT city, CASE WHEN host_tenure_years < 1 THEN '< 1 year' WHEN host_tenure_years < 3 THEN '1-3 years' WHEN host_tenure_years < 5 "
        "THEN '3-5 years' WHEN host_tenure_years < 10 THEN '5-10 years' ELSE '10+ years' END tenure_band, price_local, review_scores_rating, "
        "occupancy_rate_pct FROM (SELECT f.*, c.display_name city FROM fact_listing_snapshot f JOIN dim_city c USING (city_key)) "
        "WHERE host_tenure_years IS NOT NULL AND price_local > 0 AND price_local < 1000)")
named("tenure_distribution", _five("city, tenure_band", ["price_local", "review_scores_rating", "occupancy_rate_pct"], _TEN))
_MN = f"""SELECT city, month, month_name, day_name, day_of_week, {R('avg(minimum_nights)', 1)} avg_min_nights, {R('median(minimum_nights)', 1)} median_min_nights
 FROM cal WHERE minimum_nights > 0 AND minimum_nights < 365 GROUP BY ALL"""
explored("minimum_nights_grid", _MN)
explored("minimum_nights_by_month", "SELECT city, day_name, " + ", ".join(f"{R(f'avg(avg_min_nights) FILTER (month = {m})', 4)} month_{m}" for m in range(1, 13))
         + f" FROM ({_MN}) GROUP BY city, day_name")
_SEG = ("CASE WHEN host_listings_count IS NULL OR host_listings_count <= 0 THEN 'Unknown' WHEN host_listings_count = 1 THEN 'Single Listing' "
        "WHEN host_listings_count <= 4 THEN 'Small Portfolio (2-4)' WHEN host_listings_count <= 20 THEN 'Professional (5-20)' ELSE 'Enterprise (20+)' END")
explored("portfolio_hosts", f"SELECT {_SEG} host_segment, " + ", ".join(f"count(*) FILTER (city = '{c['display_name']}') AS \"{c['display_name']}\""
                                                                         for c in settings.CITIES.values()) + " FROM hosts GROUP BY 1")
_PERF = (f"count(listing_id) listings, {R('avg(price_local)', 2)} avg_price, {R('avg(review_scores_rating)', 2)} avg_rating, "
         f"{R('avg(occupancy_rate_pct)', 2)} avg_occupancy, {R('avg(estimated_monthly_revenue)', 2)} avg_monthly_rev")
explored("portfolio_performance", f"SELECT city, {_SEG} host_segment, {_PERF}, {R('median(price_local)', 2)} median_price FROM base GROUP BY 1, 2")
explored("superhost_premium", f"SELECT city, if(host_is_superhost, 'Superhost', 'Regular') host_type, {_PERF} FROM base GROUP BY 1, 2")
explored("supply_concentration", f"""SELECT city, top_percent, top_holders, held::DOUBLE held, {R('held * 100e0 / total', 4)} share_pct FROM (
 SELECT city, top_percent, max(top_n) top_holders, sum(host_listings_count) FILTER (rn <= top_n) held, sum(host_listings_count) total FROM (
 SELECT *, greatest(1, floor(n * top_percent / 100))::BIGINT top_n FROM (SELECT city, host_listings_count,
 row_number() OVER (PARTITION BY city ORDER BY host_listings_count DESC, host_id) rn, count(*) OVER (PARTITION BY city) n FROM hosts),
 (SELECT unnest([1, 5, 10, 20, 50]) top_percent)) GROUP BY 1, 2)""")
explored("supply_inequality", f"""SELECT city, max(n) holders, max(t)::DOUBLE total, {R('1 - 2 * sum((c + p) / 2 / n) FILTER (rn > 1)', 4)} gini FROM (
 SELECT city, rn, n, t, cum / t c, (cum - host_listings_count) / t p FROM (SELECT city, host_listings_count,
 row_number() OVER (PARTITION BY city ORDER BY host_listings_count, host_id) rn, count(*) OVER (PARTITION BY city) n,
 sum(host_listings_count) OVER (PARTITION BY city) t,
 sum(host_listings_count) OVER (PARTITION BY city ORDER BY host_listings_count, host_id) cum FROM hosts)) GROUP BY city""")
_BIN = ("(SELECT *, CASE WHEN number_of_reviews <= 5 THEN '1-5' WHEN number_of_reviews <= 10 THEN '6-10' WHEN number_of_reviews <= 25 THEN '11-25' "
        "WHEN number_of_reviews <= 50 THEN '26-50' WHEN number_of_reviews <= 100 THEN '51-100' WHEN number_of_reviews <= 200 THEN '101-200' "
        "WHEN number_of_reviews <= 500 THEN '201-500' ELSE '500+' END review_bin FROM base WHERE number_of_reviews > 0)")
explored("rating_by_review_bin", _five("city, review_bin", ["review_scores_rating"], _BIN))
explored("busy_listings", f"""SELECT score_group, count(*) listings, {R('avg(price_local)', 4)} avg_price, {R('avg(occupancy_rate_pct)', 4)} avg_occupancy,
 {R('avg(reviews_per_month)', 4)} avg_reviews_per_month, {R('median(price_local)', 4)} median_price,
 (SELECT room_type FROM (SELECT if(review_scores_rating < 4, 'low', 'normal') g, room_type, count(*) k FROM base WHERE number_of_reviews >= 50
  AND review_scores_rating IS NOT NULL GROUP BY 1, 2) m WHERE m.g = score_group ORDER BY k DESC, room_type LIMIT 1) top_room_type
 FROM (SELECT *, if(review_scores_rating < 4, 'low', 'normal') score_group FROM base WHERE number_of_reviews >= 50 AND review_scores_rating IS NOT NULL) GROUP BY 1""")
explored("busy_low_rated", f"""SELECT listing_id, city, listing_name, room_type, neighbourhood_name, {R('price_local', 4)} price_local, number_of_reviews,
 {R('review_scores_rating', 4)} review_scores_rating FROM base WHERE number_of_reviews >= 50 AND review_scores_rating < 4""")
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in settings.SUB_SCORES)
explored("sub_score_profile", "SELECT city, " + ", ".join(f"{R(f'avg({c})', 3)} {c}" for c in settings.SUB_SCORES)
         + f", {R('avg(review_scores_rating)', 3)} overall FROM base WHERE {_COMPLETE} GROUP BY city")
explored("sub_score_variance", " UNION ALL ".join(f"SELECT '{c}' dimension, {R(f'var_samp({c})', 6)} variance FROM base WHERE {_COMPLETE}"
                                                  for c in settings.SUB_SCORES), digits=6)
explored("room_price_summary", f"""SELECT city, room_type, count(price_local) AS count, {R('avg(price_local)', 2)} AS mean, {R('stddev_samp(price_local)', 2)} std,
 {R('median(price_local)', 2)} AS median FROM base WHERE price_local <= (SELECT quantile_cont(price_local, 0.99) FROM base) GROUP BY 1, 2""")
explored("market_structure", f"""SELECT city, count(*) total_listings, {R("count(*) FILTER (room_type = 'Entire home/apt') * 100e0 / count(*)", 2)} pct_entire_home,
 {R('count(*) FILTER (host_is_superhost) * 100e0 / count(*)', 2)} pct_superhost, {R('count(*) FILTER (is_professional_host) * 100e0 / count(*)', 2)} pct_professional,
 {R('median(price_usd)', 2)} median_price_usd, {R('median(review_scores_rating)', 2)} median_rating, {R('median(occupancy_rate_pct)', 2)} median_occupancy,
 {R('median(reviews_per_month)', 2)} median_reviews_per_month FROM trimmed GROUP BY city""")
explored("room_mix", "SELECT city, " + ", ".join(f"{R(f'count(*) FILTER (room_type = {chr(39)}{r}{chr(39)}) * 100e0 / count(*)', 4)} AS \"{r}\""
                                                 for r in settings.ROOM_TYPES) + " FROM trimmed GROUP BY city")
explored("availability_windows", " UNION ALL ".join(
    f"SELECT '{w}' AS \"window\", " + ", ".join(f"{R(f'avg({w}) FILTER (city = {chr(39)}{c}{chr(39)})', 4)} AS \"{c}\""
                                                for c in [x["display_name"] for x in settings.CITIES.values()]) + " FROM base"
    for w in explore.WINDOWS))
explored("occupancy_boxes", _five("city", ["occupancy_rate_pct"], "base"))
explored("professional_comparison", f"""SELECT city, if(is_professional_host, 'Professional', 'Individual') host_type,
 count(*) FILTER (ok) priced_listings, {R('avg(price_local) FILTER (ok)', 4)} avg_price, {R('stddev_samp(price_local) FILTER (ok)', 4)} std_price,
 {R('avg(occupancy_rate_pct)', 4)} avg_occupancy, {R('stddev_samp(occupancy_rate_pct)', 4)} std_occupancy, {R('avg(review_scores_rating)', 4)} avg_rating,
 {R('stddev_samp(review_scores_rating)', 4)} std_rating FROM (SELECT *, price_local <= (SELECT quantile_cont(price_local, 0.95) FROM base) ok FROM base) GROUP BY 1, 2""")


def _hist(col, src, bins):
    return (f"SELECT city, bin, {R('lo + (hi - lo) / %d * bin' % bins, 4)} lower, {R('lo + (hi - lo) / %d * (bin + 1)' % bins, 4)} upper, n FROM ("
            f"SELECT city, if(hi > lo, least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}), 0)::INT bin, lo, hi, count(*) n FROM ("
            f"SELECT city, v, min(v) OVER (PARTITION BY city) lo, max(v) OVER (PARTITION BY city) hi FROM (SELECT city, {col}::DOUBLE v FROM {src})) "
            "GROUP BY ALL)")


explored("review_count_histogram", _hist("least(number_of_reviews, 300)", "base WHERE number_of_reviews > 0", 50))
explored("review_count_histogram", _hist("log10(number_of_reviews)", "base WHERE number_of_reviews > 0", 40), key="review_count_histogram_log", log=True)
explored("portfolio_histogram", _hist("least(host_listings_count, 50)", "hosts", 50))
explored("portfolio_histogram", _hist("log10(host_listings_count)", "hosts WHERE host_listings_count > 0", 30), key="portfolio_histogram_log", log=True)
explored("rating_shares", f"""SELECT count(*) rated, {R('count(*) FILTER (review_scores_rating >= 4.0) * 100e0 / count(*)', 4)} pct_4_0,
 {R('count(*) FILTER (review_scores_rating >= 4.5) * 100e0 / count(*)', 4)} pct_4_5, {R('median(review_scores_rating)', 4)} median_rating
 FROM base WHERE review_scores_rating IS NOT NULL""")
explored("demand_correlation", f"SELECT city, {R('corr(reviews_per_month, occupancy_rate_pct)', 6)} correlation FROM base GROUP BY city", digits=6)
explored("top_areas_by_median", f"""SELECT city, neighbourhood_name, {R('m', 4)} median_price, place FROM (SELECT *, row_number() OVER (PARTITION BY city
 ORDER BY m DESC, neighbourhood_name)::INT place FROM (SELECT city, neighbourhood_name, median(price_local) m FROM base GROUP BY 1, 2)) WHERE place <= 15""")
named("weekend_pairs", f"""SELECT listing_key, {R('a', 4)} weekend_price, {R('b', 4)} weekday_price FROM (SELECT listing_key, avg(price_local) FILTER (is_weekend) a,
 avg(price_local) FILTER (NOT is_weekend) b FROM fact_calendar JOIN dim_date USING (date_key) WHERE price_local > 0 GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL""")

_AD_HOC = ("SELECT city_key, count(*) AS listings, max(number_of_reviews) AS most_reviews FROM fact_listing_snapshot GROUP BY city_key")
ENTRIES["ad_hoc_sql"] = (lambda s, d: run_sql(s, wh(s, d).star, sql=_AD_HOC), statement(_AD_HOC))
ENTRIES["named_sql"] = (lambda s, d: fixed(run_sql(s, wh(s, d).star, name="executive_kpis", city_key=1)), statement(_KPI + " WHERE city_key = 1"))
