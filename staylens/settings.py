"""Cleaning and validation rules, canonical names, cities, rates, model settings.

Everything in this file is data that results depend on; the code that applies it lives in
``operators`` and ``functions``.
"""

# ---- fixed values: cities, in dimension-key order -------------------------------------------
CITIES = {
    "amsterdam": {"display_name": "Amsterdam", "country": "the-netherlands", "currency_code": "EUR",
                  "currency_symbol": "€", "timezone": "Europe/Amsterdam", "scrape_date": "2025-09-11",
                  "admin_unit_name": "Neighbourhood"},
    "new_york_city": {"display_name": "New York City", "country": "united-states", "currency_code": "USD",
                      "currency_symbol": "$", "timezone": "America/New_York", "scrape_date": "2026-04-14",
                      "admin_unit_name": "Borough"},
    "barcelona": {"display_name": "Barcelona", "country": "spain", "currency_code": "EUR",
                  "currency_symbol": "€", "timezone": "Europe/Barcelona", "scrape_date": "2026-03-21",
                  "admin_unit_name": "Borough"},
}

# ---- fixed values: exchange rates, activity and professional-host thresholds ----------------
USD_RATES = {"USD": 1.00, "EUR": 1.08, "GBP": 1.27}
ACTIVE_REVIEW_MONTHS = 12
ACTIVE_MIN_AVAILABILITY = 1
PROFESSIONAL_MIN_LISTINGS = 3
NULL_TOKENS = ["", "N/A", "NA"]

# ---- fixed values: column groups and rules of the cleaning step ------------------------------
ROOM_TYPES = ["Entire home/apt", "Private room", "Shared room", "Hotel room"]
SUB_SCORES = ["review_scores_accuracy", "review_scores_cleanliness", "review_scores_checkin",
              "review_scores_communication", "review_scores_location", "review_scores_value"]

CLEANING = {
    "listings": {
        "integer": ["id:long", "host_id:long", "host_listings_count:int", "host_total_listings_count:int",
                    "calculated_host_listings_count:int", "accommodates:int", "bedrooms:int", "beds:int",
                    "minimum_nights:int", "maximum_nights:int", "availability_30:int", "availability_60:int",
                    "availability_90:int", "availability_365:int", "number_of_reviews:int",
                    "number_of_reviews_ltm:int"],
        "decimal": ["latitude", "longitude", "review_scores_rating", *SUB_SCORES, "reviews_per_month"],
        "price": ["price"],
        "boolean": ["host_is_superhost", "host_has_profile_pic", "host_identity_verified",
                    "instant_bookable", "has_availability"],
        "date": ["host_since", "first_review", "last_review", "last_scraped"],
        "percentage": ["host_response_rate", "host_acceptance_rate"],
        "special": {"bathrooms_text": "parse_bathrooms", "amenities": "parse_amenities",
                    "host_verifications": "parse_list"},
        "text": ["property_type", "neighbourhood_cleansed", "neighbourhood_group_cleansed"],
        "missing": {
            "id": {"strategy": "reject"}, "host_id": {"strategy": "reject"}, "price": {"strategy": "reject"},
            "latitude": {"strategy": "reject"}, "longitude": {"strategy": "reject"},
            "name": {"strategy": "sentinel", "fill_value": "Untitled"},
            "host_name": {"strategy": "sentinel", "fill_value": "Unknown"},
            "description": {"strategy": "explicit_null"},
            "neighbourhood_group_cleansed": {"strategy": "sentinel", "fill_value": "Unknown"},
            "bedrooms": {"strategy": "impute_median_by_group", "group_columns": ["room_type", "accommodates"]},
            "beds": {"strategy": "impute_median_by_group", "group_columns": ["room_type", "accommodates"]},
            "bathrooms": {"strategy": "impute_median_by_group", "group_columns": ["room_type", "accommodates"]},
            "review_scores_rating": {"strategy": "explicit_null"},
            "license": {"strategy": "explicit_null"},
        },
        "rules": {
            "price": [{"check": "not_null"}, {"check": "positive"}],
            "latitude": [{"check": "not_null"}, {"check": "range", "min": -90.0, "max": 90.0}],
            "longitude": [{"check": "not_null"}, {"check": "range", "min": -180.0, "max": 180.0}],
            "accommodates": [{"check": "positive"}],
            "room_type": [{"check": "not_null"}, {"check": "enum", "values": ROOM_TYPES}],
        },
    },
    "calendar": {
        "integer": ["listing_id:long", "minimum_nights:int", "maximum_nights:int"],
        "price": ["price", "adjusted_price"],
        "boolean": ["available"],
        "date": ["date"],
        "missing": {"listing_id": {"strategy": "reject"}, "date": {"strategy": "reject"},
                    "available": {"strategy": "reject"}, "price": {"strategy": "explicit_null"},
                    "adjusted_price": {"strategy": "explicit_null"}},
        "rules": {"listing_id": [{"check": "not_null"}, {"check": "positive"}], "date": [{"check": "not_null"}]},
    },
    "reviews": {
        "integer": ["id:long", "listing_id:long", "reviewer_id:long"],
        "date": ["date"],
        "special": {"comments": "strip_html"},
        "missing": {"id": {"strategy": "reject"}, "listing_id": {"strategy": "reject"},
                    "date": {"strategy": "reject"}, "comments": {"strategy": "explicit_null"}},
        "rules": {"listing_id": [{"check": "not_null"}, {"check": "positive"}], "date": [{"check": "not_null"}]},
    },
    "neighbourhoods": {
        "text": ["neighbourhood", "neighbourhood_group"],
        "missing": {"neighbourhood": {"strategy": "reject"}},
        "rules": {"neighbourhood": [{"check": "not_null"}]},
    },
}

# ---- fixed values: report rules on raw columns ------------------------------------------------
PRICE_PATTERN = r"^\$[0-9,]+\.[0-9]{2}$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
REPORT_RULES = {
    "listings": {
        "id": {"not_null": True, "unique": True, "positive": True},
        "host_id": {"not_null": True, "positive": True},
        "latitude": {"not_null": True, "range": {"min": -90.0, "max": 90.0}},
        "longitude": {"not_null": True, "range": {"min": -180.0, "max": 180.0}},
        "room_type": {"not_null": True, "enum": ROOM_TYPES},
        "accommodates": {"not_null": True, "positive": True},
        "price": {"not_null": True, "regex": PRICE_PATTERN},
        "minimum_nights": {"not_null": True, "positive": True},
        "maximum_nights": {"not_null": True, "positive": True},
        "number_of_reviews": {"not_null": True, "range": {"min": 0}},
        "availability_365": {"range": {"min": 0, "max": 365}},
        "review_scores_rating": {"range": {"min": 0, "max": 100}},
    },
    "calendar": {
        "listing_id": {"not_null": True, "positive": True},
        "date": {"not_null": True, "regex": DATE_PATTERN},
        "available": {"not_null": True, "enum": ["t", "f"]},
        "price": {"regex": PRICE_PATTERN},
    },
    "reviews": {
        "id": {"not_null": True, "unique": True, "positive": True},
        "listing_id": {"not_null": True, "positive": True},
        "date": {"not_null": True, "regex": DATE_PATTERN},
    },
    "neighbourhoods": {"neighbourhood": {"not_null": True, "unique": True}},
}
PRIMARY_KEYS = {"listings": ["id"], "calendar": ["listing_id", "date"], "reviews": ["id"],
                "neighbourhoods": ["neighbourhood"]}
RELATIONS = [
    ("listing_to_calendar", "listings", "id", "calendar", "listing_id"),
    ("listing_to_reviews", "listings", "id", "reviews", "listing_id"),
    ("neighbourhood_to_listing", "neighbourhoods", "neighbourhood", "listings", "neighbourhood_cleansed"),
]
OUTLIER_TARGETS = {
    "listings": ["price", "minimum_nights", "maximum_nights", "number_of_reviews", "reviews_per_month",
                 "availability_365", "accommodates", "calculated_host_listings_count"],
    "calendar": ["price", "minimum_nights", "maximum_nights"],
}
CRITICAL_COLUMNS = ["price", "latitude", "longitude", "id"]
HTML_TAG_PATTERN = "<[a-zA-Z][^>]*>"
MOJIBAKE_PATTERN = "Ã©|Ã¨|Ã |Ã§|â€™|â€œ|â€"

# ---- fixed values: alias -> canonical name, type, transform ------------------------------------
SCHEMA_MAP = {
    "listings": {
        "listing_id": (["id"], "bigint", None), "listing_url": (["listing_url"], "string", None),
        "name": (["name"], "string", None), "description": (["description"], "string", "strip_html"),
        "host_id": (["host_id"], "bigint", None), "host_name": (["host_name"], "string", None),
        "host_since": (["host_since"], "date", None),
        "host_response_time": (["host_response_time"], "string", None),
        "host_response_rate": (["host_response_rate"], "double", "parse_rate_pct"),
        "host_acceptance_rate": (["host_acceptance_rate"], "double", "parse_rate_pct"),
        "host_is_superhost": (["host_is_superhost"], "boolean", "parse_boolean"),
        "host_listings_count": (["host_listings_count", "host_total_listings_count"], "int", None),
        "host_verifications": (["host_verifications"], "string", "parse_host_verifications"),
        "host_identity_verified": (["host_identity_verified"], "boolean", "parse_boolean"),
        "neighbourhood_cleansed": (["neighbourhood_cleansed", "neighborhood_cleansed"], "string", None),
        "neighbourhood_group_cleansed": (["neighbourhood_group_cleansed", "neighborhood_group_cleansed"],
                                         "string", None),
        "latitude": (["latitude"], "double", None), "longitude": (["longitude"], "double", None),
        "property_type": (["property_type"], "string", None), "room_type": (["room_type"], "string", None),
        "accommodates": (["accommodates"], "int", None),
        "bathrooms": (["bathrooms_text", "bathrooms"], "double", "parse_bathrooms_text"),
        "bedrooms": (["bedrooms"], "int", None), "beds": (["beds"], "int", None),
        "amenities": (["amenities"], "string", "parse_amenities"),
        "price_local": (["price"], "double", "clean_price"),
        "minimum_nights": (["minimum_nights"], "int", None),
        "maximum_nights": (["maximum_nights"], "int", None),
        "number_of_reviews": (["number_of_reviews"], "int", None),
        "number_of_reviews_ltm": (["number_of_reviews_ltm"], "int", None),
        "first_review": (["first_review"], "date", None), "last_review": (["last_review"], "date", None),
        "review_scores_rating": (["review_scores_rating"], "double", None),
        "reviews_per_month": (["reviews_per_month"], "double", None),
        "license": (["license", "licence"], "string", None),
        "instant_bookable": (["instant_bookable"], "boolean", "parse_boolean"),
        "availability_365": (["availability_365"], "int", None),
    },
    "calendar": {
        "listing_id": (["listing_id"], "bigint", None), "date": (["date"], "date", None),
        "available": (["available"], "boolean", "parse_boolean"),
        "price_local": (["price"], "double", "clean_price"),
        "adjusted_price_local": (["adjusted_price"], "double", "clean_price"),
        "minimum_nights": (["minimum_nights"], "int", None),
        "maximum_nights": (["maximum_nights"], "int", None),
    },
    "reviews": {
        "review_id": (["id"], "bigint", None), "listing_id": (["listing_id"], "bigint", None),
        "date": (["date"], "date", None), "reviewer_id": (["reviewer_id"], "bigint", None),
        "reviewer_name": (["reviewer_name"], "string", None),
        "comments": (["comments"], "string", "strip_html"),
    },
    "neighbourhoods": {
        "neighbourhood": (["neighbourhood", "neighborhood"], "string", None),
        "neighbourhood_group": (["neighbourhood_group", "neighborhood_group"], "string", None),
    },
}

# ---- fixed values: features and models ---------------------------------------------------------
NUMERIC_FEATURES = ["accommodates", "bedrooms", "beds", "bathrooms", "amenity_count", "number_of_reviews",
                    "number_of_reviews_ltm", "review_scores_rating", *SUB_SCORES, "reviews_per_month",
                    "availability_30", "availability_60", "availability_90", "availability_365",
                    "minimum_nights", "maximum_nights", "host_tenure_years", "host_listings_count",
                    "host_response_rate", "latitude", "longitude", "occupancy_rate_pct"]
CATEGORICAL_FEATURES = ["room_type", "city", "neighbourhood_group", "host_response_time"]
BOOLEAN_FEATURES = ["host_is_superhost", "instant_bookable", "host_identity_verified", "is_professional_host"]
LEAKAGE_COLUMNS = ["price_local", "price_usd", "price_per_bedroom", "price_per_person",
                   "price_vs_neighbourhood", "estimated_annual_revenue", "estimated_monthly_revenue",
                   "avg_booked_price"]
AMENITY_FLAGS = {
    "has_wifi": ["wifi", "wi-fi", "internet"], "has_kitchen": ["kitchen"],
    "has_washer": ["washer", "washing machine"], "has_air_conditioning": ["air conditioning", "ac", "a/c"],
    "has_parking": ["parking", "garage"], "has_pool": ["pool"], "has_gym": ["gym", "fitness"],
    "has_elevator": ["elevator", "lift"], "has_dishwasher": ["dishwasher"], "has_tv": ["tv", "television"],
    "has_self_checkin": ["self check-in", "lockbox", "keypad"], "has_workspace": ["workspace", "laptop", "desk"],
}
INTERACTIONS = [("accommodates", "bedrooms"), ("bedrooms", "bathrooms")]
CITY_CENTRES = {"paris": (48.8566, 2.3522), "london": (51.5074, -0.1278), "new_york_city": (40.7128, -74.0060)}
MAX_CARDINALITY = 20
MISSING_CATEGORY = "__MISSING__"
OTHER_CATEGORY = "__OTHER__"
RARE_STRATUM = "__RARE__"
SPLIT_SEED = 42
TEST_SHARE = 0.20
FOLDS = 5
TARGETS = {"mae": 25.0, "mape": 25.0, "r2": 0.55}
BIAS_DIMENSIONS = ["city", "neighbourhood_group", "room_type", "is_professional_host", "host_is_superhost",
                   "price_quintile", "has_reviews"]
MODELS = {
    "ridge": {"search": "grid", "grid": {"regParam": [0.01, 0.1, 1.0, 10.0, 100.0]}},
    "random_forest": {"search": "random", "draws": 2,
                      "grid": {"numTrees": [50], "maxDepth": [10], "minInstancesPerNode": [10]}},
    "xgboost": {"search": "random", "draws": 5,
                "grid": {"maxIter": [100, 200], "maxDepth": [4, 6], "stepSize": [0.05, 0.1],
                         "subsamplingRate": [0.8]}},
    "lightgbm": {"search": "random", "draws": 5,
                 "grid": {"maxIter": [100, 200], "maxDepth": [4, 6], "stepSize": [0.05, 0.1],
                          "subsamplingRate": [0.8]}},
}
MAX_DUMMIES = 10_000  # columns of one category when none are merged; beyond it the call fails
QUANTILES = (0.10, 0.90)
QUANTILE_TREES = {"rounds": 20, "trees": 10, "depth": 4, "step": 0.25, "row_share": 0.8, "feature_share": 0.8, "min_rows": 20}
ESTIMATOR_DEFAULTS = {"accommodates": 2.0, "bedrooms": 1.0, "beds": 1.0, "bathrooms": 1.0,
                      "amenity_count": 15.0, "number_of_reviews": 10.0, "review_scores_rating": 4.8,
                      "availability_365": 100.0, "minimum_nights": 2.0, "host_tenure_years": 5.0,
                      "latitude": 48.85, "longitude": 2.35, "distance_to_centre_km": 3.0,
                      "occupancy_rate_pct": 50.0}
