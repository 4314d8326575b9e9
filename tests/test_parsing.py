import datetime as dt

from pyspark.sql import functions as F

from staylens.functions import bands, geo
from staylens.functions import parsing as P
from staylens.functions.rounding import stable_round


def test_prices(one):
    assert one("p string", [("$100.00",), ("$1,250.00",), ("$0.00",), ("€99.00",), ("€1.500,00",), ("",), (None,), ("ask",)],
               P.clean_price("p")) == [100.0, 1250.0, 0.0, 99.0, 1.5, None, None, None]


def test_currency(one):
    assert one("p string", [("$1",), ("€99",), ("£5",), ("7",), (None,)], P.price_currency("p")) == ["$", "€", "£", None, None]


def test_booleans(one):
    assert one("b string", [("t",), ("f",), ("yes",), (None,), (" T ",)], P.true_false("b")) == [True, False, None, None, None]
    assert one("b string", [(" T ",), ("F",)], P.true_false("b", lenient=True)) == [True, False]


def test_dates(one):
    assert one("d string", [("2024-01-15",), ("not-a-date",), (None,)], P.iso_date("d")) == [dt.date(2024, 1, 15), None, None]


def test_percent(one):
    assert one("r string", [("95%",), ("100%",), ("0%",), (None,), ("N/A",)], P.percent("r")) == [0.95, 1.0, 0.0, None, None]


def test_bathrooms(one):
    rows = [("1.5 baths",), ("Half-bath",), ("Shared half-bath",), (None,), ("0 baths",), ("Bath",)]
    assert one("t string", rows, P.bathrooms("t"), P.bathrooms_shared("t")) == [
        (1.5, False), (0.5, False), (0.5, True), (None, None), (0.0, False), (None, False)]


def test_amenities(one):
    rows = [('["Wifi","Kitchen","Pool"]',), ("[]",), (None,), ('["a", "b"]',)]
    assert one("a string", rows, P.amenity_count("a")) == [3, 0, 0, 1]
    rows = [('["Wifi", "Kitchen", "Wifi"]',), ('{"Wifi", Kitchen}',), ("",), (None,), ("junk",)]
    assert one("a string", rows, P.amenity_list("a")) == [["Kitchen", "Wifi"], ["Kitchen", "Wifi"], [], [], []]


def test_verifications(one):
    rows = [("['email', 'phone', 'email']",), ("[]",), (None,)]
    assert one("v string", rows, P.verification_count("v")) == [3, 0, 0]
    assert one("v string", rows, P.verification_list("v")) == [["email", "email", "phone"], [], []]


def test_html_and_text(one):
    assert one("t string", [("<b>Hello</b> world",), ("A &amp; B",), ("<br/>",), (None,)], P.strip_html("t")) == ["Hello world", "A & B", "", None]
    assert one("t string", [("<br/>",), ("it&#39;s",)], P.strip_html_or_null("t")) == [None, "it's"]
    assert one("t string", [("  Entire   home/apt ",), (None,)], P.tidy_text("t")) == ["Entire home/apt", None]


def test_schema_hash_ignores_order():
    assert P.schema_hash(["b", "a"]) == P.schema_hash(["a", "b"]) and len(P.schema_hash(["a"])) == 32
    assert P.schema_hash(["a"]) != P.schema_hash(["a", "b"])


def test_integers_round_half_even(one):
    assert one("x double", [(2.5,), (3.5,), (3.7,), (None,)], P.to_number("x", "int")) == [2, 4, 4, None]


def test_stable_round(one):
    assert one("x double", [(1.005,), (2.5,), (-2.5,), (0.1 + 0.2,), (None,)], stable_round("x", 2)) == [1.01, 2.5, -2.5, 0.3, None]
    assert one("x double", [(2.5,), (-2.5,), (2.4999999999,)], stable_round("x", 0)) == [3.0, -3.0, 3.0]


def test_bands(one):
    assert one("x double", [(1.3,), (1.2,), (0.8,), (0.7,), (None,)], bands.price_segment("x")) == [
        bands.PREMIUM, bands.MID_RANGE, bands.MID_RANGE, bands.BUDGET, bands.UNKNOWN]
    assert one("x int", [(None,), (0,), (1,), (4,), (20,), (21,)], bands.portfolio_segment("x")) == [
        "Unknown", "Unknown", *[s for _, s in bands.SEGMENTS], bands.SEGMENT_LAST]
    assert one("x int", [(0,), (5,), (6,), (501,)], bands.review_bin("x")) == [None, "1-5", "6-10", "500+"]


def test_health_score_ignores_missing_parts_by_clipping(one):
    got = one("p double, a double, r double, o double", [(100.0, 100.0, 5.0, 100.0), (300.0, 100.0, 3.0, 0.0), (1.0, 0.0, 5.0, 100.0)],
              bands.health_score("p", "a", "r", "o"))
    assert got[0] == round((5 * .25 + 9.99 * .4 + 10 * .35) * 10, 1) and got[1] == 0.0
    # an unknown relative price is clipped to the lower bound, as least/greatest skip NULL
    assert got[2] == round((0 * .25 + 9.99 * .4 + 10 * .35) * 10, 1)


def test_weeks_before_first_monday(one):
    d = bands.date_parts("d")
    rows = [(dt.date(2023, 1, 1),), (dt.date(2023, 1, 2),), (dt.date(2024, 1, 1),)]
    assert one("d date", rows, d["week_of_year"], d["day_of_week"], d["is_weekend"]) == [(0, 0, True), (1, 1, False), (1, 1, False)]


def test_distances(spark):
    df = spark.createDataFrame([(40.7128, -74.0060, "new_york_city"), (40.72, -74.0, "new_york_city"), (1.0, 1.0, "nowhere")],
                               "lat double, lon double, c string")
    km = [r[0] for r in geo.with_centre_distance(df, {"new_york_city": (40.7128, -74.0060)}, "c", "lat", "lon").select("distance_to_centre_km").collect()]
    assert km[0] == 0 and 0 < km[1] < 2 and km[2] is None
    flat = df.select(geo.flat_km("lat", "lon", F.lit(40.7128), F.lit(-74.0060)).alias("k")).collect()
    assert abs(flat[1].k - km[1]) < 0.01
