"""Business bands, labels, scores and date parts as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import as_col, ratio, stable_round

# fixed values: label texts
PREMIUM, MID_RANGE, BUDGET, UNKNOWN = ("Premium (>120% median)", "Mid-range (80-120%)",
                                       "Budget (<80% median)", "Unknown")
TENURE_BANDS = [(1, "< 1 year"), (3, "1-3 years"), (5, "3-5 years"), (10, "5-10 years")]
TENURE_LAST = "10+ years"
SEGMENTS = [(1, "Single Listing"), (4, "Small Portfolio (2-4)"), (20, "Professional (5-20)")]
SEGMENT_LAST = "Enterprise (20+)"
SEGMENT_ORDER = [s for _, s in SEGMENTS] + [SEGMENT_LAST]
REVIEW_BINS = [(5, "1-5"), (10, "6-10"), (25, "11-25"), (50, "26-50"), (100, "51-100"), (200, "101-200"),
               (500, "201-500")]
REVIEW_LAST = "500+"
UNDERPRICED = "🔥 Underpriced relative to demand"
OVERPRICED = "📉 Price too high for market position"
LOW_QUALITY = "⚠️ Low review quality risk"
WEAK_CONVERSION = "🛑 High availability but weak conversion"
PORTFOLIO_RISK = "🏢 Host portfolio quality risk"
HEALTHY = "✅ Healthy Market Position"
ZONE_VALUE = "🚀 High Demand / Value Zone"
ZONE_SATURATED = "⚠️ Over-saturated area"
ZONE_PREMIUM = "💎 Premium Pocket"
ZONE_WEAK = "🚩 Weak-performing zone"
ZONE_NEUTRAL = "Neutral"


def _first_match(cases: list[tuple[Column, str]], default: str) -> Column:
    out = F.lit(default)
    for cond, label in reversed(cases):
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def price_segment(index) -> Column:
    x = as_col(index)
    return _first_match([(x > 1.2, PREMIUM), (x.between(0.8, 1.2), MID_RANGE), (x < 0.8, BUDGET)], UNKNOWN)


def tenure_band(years) -> Column:
    return _first_match([(as_col(years) < top, label) for top, label in TENURE_BANDS], TENURE_LAST)


def portfolio_segment(count) -> Column:
    x = as_col(count)
    cases = [(x.isNull() | (x <= 0), UNKNOWN)] + [(x <= top, label) for top, label in SEGMENTS]
    return _first_match(cases, SEGMENT_LAST)


def review_bin(count) -> Column:
    """Right-closed bins; counts of 0 and NULL have none."""
    x = as_col(count)
    return F.when(x > 0, _first_match([(x <= top, label) for top, label in REVIEW_BINS], REVIEW_LAST))


def flag_label(flag, yes: str, no: str) -> Column:
    return F.when(as_col(flag), F.lit(yes)).otherwise(F.lit(no))


def yes_no_label(flag, yes: str, no: str) -> Column:
    """As :func:`flag_label`, but an unknown flag stays unknown."""
    x = as_col(flag)
    return F.when(x, F.lit(yes)).when(~x, F.lit(no))


def _score_part(x: Column, weight: float) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(10.0)) * F.lit(weight)


def health_score(price, area_price, rating, occupancy) -> Column:
    """0..100 from relative price (25 %), rating (40 %) and occupancy (35 %)."""
    parts = (_score_part(F.lit(10.0) - ratio(price, area_price) * 5, 0.25)
             + _score_part((as_col(rating) - 3.5) * 6.66, 0.40)
             + _score_part(as_col(occupancy) / 10, 0.35))
    return stable_round(parts * 10, 1)


def priority_action(price, area_price, rating, occupancy, reviews, availability, professional) -> Column:
    p, a, r, o = as_col(price), as_col(area_price), as_col(rating), as_col(occupancy)
    return _first_match([
        ((p < a * 0.8) & (o > 75) & (r >= 4.8), UNDERPRICED),
        ((p > a * 1.3) & (o < 30), OVERPRICED),
        ((r < 4.4) & (as_col(reviews) > 20), LOW_QUALITY),
        ((as_col(availability) > 300) & (o < 15), WEAK_CONVERSION),
        (as_col(professional) & (r < 4.6), PORTFOLIO_RISK),
    ], HEALTHY)


def opportunity_zone(occupancy, price, listings, rating, market_price) -> Column:
    o, p, m = as_col(occupancy), as_col(price), as_col(market_price)
    return _first_match([
        ((o > 65) & (p < m), ZONE_VALUE),
        ((o < 35) & (as_col(listings) > 200), ZONE_SATURATED),
        (p > m * 1.5, ZONE_PREMIUM),
        (as_col(rating) < 4.5, ZONE_WEAK),
    ], ZONE_NEUTRAL)


def date_parts(day) -> dict[str, Column]:
    """Date dimension columns; weeks start on Monday and days before the first Monday are week 0."""
    d = as_col(day)
    sunday_first = F.dayofweek(d) - 1
    return {
        "date_key": F.date_format(d, "yyyyMMdd").cast("int"),
        "full_date": d,
        "year": F.year(d).cast("smallint"),
        "quarter": F.quarter(d).cast("tinyint"),
        "month": F.month(d).cast("tinyint"),
        "day_of_month": F.dayofmonth(d).cast("tinyint"),
        "day_of_week": sunday_first.cast("tinyint"),
        "day_name": F.date_format(d, "EEEE"),
        "month_name": F.date_format(d, "MMMM"),
        "is_weekend": sunday_first.isin(0, 6),
        "week_of_year": F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("tinyint"),
    }


def month_start(year, month) -> Column:
    return F.make_date(as_col(year).cast("int"), as_col(month).cast("int"), F.lit(1))
