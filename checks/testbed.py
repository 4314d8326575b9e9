"""Raw rental files derived from the provided tables.

The provided tables hold no listings, so each raw column is an expression over ``part`` (listings),
``lineitem`` (calendar), ``orders`` (reviews) and ``nation``/``region`` (neighbourhoods), written in the SQL
both engines read.  The data carry the faults the cleaning step is for: missing and malformed values, unknown
room types, zero prices, doubled blanks.  A third of all listings lie in one neighbourhood.
"""

CITY_OF = "CASE {nk} % 3 WHEN 0 THEN 'amsterdam' WHEN 1 THEN 'new_york_city' ELSE 'barcelona' END"
NATION_OF = "CASE WHEN {k} % 3 = 0 THEN 0 ELSE {k} % 25 END"


def _int(x):
    return f"CAST({x} AS BIGINT)"


def _text(x):
    return f"CAST({x} AS STRING)"


def _money(cents, mark="'$'"):
    dollars = f"CAST(floor(({cents}) / 100) AS BIGINT)"
    big = (f"CASE WHEN {dollars} >= 1000 THEN {_text(f'CAST(floor({dollars} / 1000) AS BIGINT)')} || ',' || "
           f"lpad({_text(f'{dollars} % 1000')}, 3, '0') ELSE {_text(dollars)} END")
    return f"{mark} || {big} || '.' || lpad({_text(f'({cents}) % 100')}, 2, '0')"


def _hundredths(n):
    return (f"{_text(f'CAST(floor(({n}) / 100) AS BIGINT)')} || '.' || lpad({_text(f'({n}) % 100')}, 2, '0')")


def _day(start, offset):
    return _text(f"DATE '{start}' + CAST({offset} AS INT)")


K, SIZE = "p.p_partkey", "p.p_size"
HOST = "CAST(floor(p.p_partkey / (1 + p.p_partkey % 7)) AS BIGINT)"
CENTS = f"CAST(round(p.p_retailprice * 10) AS BIGINT) * (1 + {SIZE})"
CITY = CITY_OF.format(nk=f"({NATION_OF.format(k=K)})")
UNRATED = f"{K} % 5 = 2"


def _score(base, step, span, extra="FALSE"):
    return f"CASE WHEN {UNRATED} OR {extra} THEN NULL ELSE {_hundredths(f'{base} + {K} * {step} % {span}')} END"


LISTINGS = {
    "city": CITY,
    "id": f"CASE WHEN {K} % 211 = 17 THEN NULL ELSE {_text(f'{K} + 1')} END",
    "listing_url": f"'https://rooms.example.com/' || {_text(K)}",
    "name": f"CASE WHEN {K} % 13 = 5 THEN NULL ELSE p.p_name END",
    "description": f"'<p>' || p.p_name || ' &amp; more</p> '",
    "last_scraped": f"CASE ({CITY}) WHEN 'amsterdam' THEN '2025-09-11' WHEN 'new_york_city' THEN '2026-04-14' "
                    "ELSE '2026-03-21' END",
    "host_id": f"CASE WHEN {K} % 223 = 19 THEN NULL ELSE {_text(HOST)} END",
    "host_name": f"CASE WHEN {HOST} % 17 = 3 THEN NULL ELSE 'Host ' || {_text(HOST)} END",
    "host_since": f"CASE WHEN {HOST} % 29 = 4 THEN 'unknown' ELSE {_day('2008-01-01', f'{HOST} * 37 % 6000')} END",
    "host_location": f"'Area ' || {_text(f'{HOST} % 40')}",
    "host_response_time": f"CASE {K} % 4 WHEN 0 THEN 'within an hour' WHEN 1 THEN 'within a few hours' "
                          "WHEN 2 THEN 'within a day' ELSE NULL END",
    "host_response_rate": f"CASE WHEN {K} % 9 = 0 THEN 'N/A' ELSE {_text(f'{SIZE} * 2')} || '%' END",
    "host_acceptance_rate": f"CASE WHEN {K} % 8 = 0 THEN NULL ELSE {_text(f'100 - {SIZE}')} || '%' END",
    "host_is_superhost": f"CASE WHEN {HOST} % 11 = 5 THEN NULL WHEN {HOST} % 3 = 0 THEN 't' ELSE 'f' END",
    "host_has_profile_pic": f"CASE WHEN {HOST} % 20 = 1 THEN 'f' ELSE 't' END",
    "host_identity_verified": f"CASE WHEN {HOST} % 2 = 1 THEN 't' ELSE 'f' END",
    "host_listings_count": _text(f"1 + ({HOST} % 6) * ({HOST} % 5)"),
    "host_total_listings_count": _text(f"2 + ({HOST} % 6) * ({HOST} % 5)"),
    "calculated_host_listings_count": _text(f"1 + ({HOST} % 6) * ({HOST} % 5)"),
    "host_verifications": f"CASE {K} % 3 WHEN 0 THEN replace('[#email#, #phone#]', '#', chr(39)) "
                          "WHEN 1 THEN replace('[#phone#]', '#', chr(39)) ELSE '[]' END",
    "neighbourhood_cleansed": "'  ' || replace(n.n_name, '_', '   ') || ' '",
    "neighbourhood_group_cleansed": f"CASE WHEN {K} % 12 = 1 THEN NULL ELSE r.r_name END",
    "latitude": f"CASE WHEN {K} % 401 = 7 THEN NULL WHEN {K} % 409 = 8 THEN '95.5' WHEN ({CITY}) = 'new_york_city' "
                f"THEN '40.' || lpad({_text(f'{K} % 1000')}, 3, '0') ELSE '52.' || lpad({_text(f'{K} % 1000')}, 3, '0') END",
    "longitude": f"CASE WHEN ({CITY}) = 'new_york_city' THEN '-73.' || lpad({_text(f'{K} * 7 % 1000')}, 3, '0') "
                 f"ELSE '4.' || lpad({_text(f'{K} * 7 % 1000')}, 3, '0') END",
    "property_type": "' ' || p.p_brand || '   unit '",
    "room_type": f"CASE p.p_type WHEN 'STANDARD' THEN 'Entire home/apt' WHEN 'MEDIUM' THEN 'Entire home/apt' "
                 "WHEN 'ECONOMY' THEN 'Private room' WHEN 'SMALL' THEN 'Shared room' WHEN 'LARGE' THEN 'Hotel room' "
                 f"ELSE CASE WHEN {K} % 10 = 0 THEN 'Boat' ELSE 'Entire home/apt' END END",
    "accommodates": f"CASE WHEN {K} % 301 = 5 THEN '0' ELSE {_text(f'1 + {SIZE} % 8')} END",
    "bathrooms_text": f"CASE {K} % 9 WHEN 0 THEN '1.5 baths' WHEN 1 THEN 'Half-bath' WHEN 2 THEN 'Shared half-bath' "
                      "WHEN 3 THEN '2 shared baths' WHEN 4 THEN '1 bath' WHEN 5 THEN NULL WHEN 6 THEN '0 baths' "
                      "WHEN 7 THEN 'Bath' ELSE '3 baths' END",
    "bedrooms": f"CASE WHEN {K} % 10 = 3 THEN NULL ELSE {_text(f'{SIZE} % 5')} END",
    "beds": f"CASE WHEN {K} % 10 = 4 THEN NULL ELSE {_text(f'1 + {SIZE} % 4')} END",
    "amenities": f"CASE {K} % 7 WHEN 0 THEN '[]' WHEN 1 THEN NULL WHEN 2 THEN '{{Wifi,\"Washer\"}}' "
                 "WHEN 3 THEN '[\"Wifi\",\"Kitchen\",\"Pool\"]' WHEN 4 THEN '[\"TV\", \"Air conditioning\", \"Wifi\"]' "
                 "WHEN 5 THEN '[\"Backyard\",\"Free parking\",\"Wifi\",\"Wifi\"]' "
                 "ELSE '[\"Self check-in\",\"Dedicated workspace\",\"Gym\",\"Elevator\"]' END",
    "price": f"CASE WHEN {K} % 50 = 7 THEN NULL WHEN {K} % 50 = 8 THEN '' WHEN {K} % 199 = 5 THEN 'ask' "
             f"WHEN {K} % 97 = 11 THEN '$0.00' ELSE "
             + _money(CENTS, f"(CASE WHEN ({CITY}) = 'new_york_city' THEN '$' ELSE '€' END)") + " END",
    "minimum_nights": _text(f"1 + {SIZE} % 30"),
    "maximum_nights": _text(f"365 + {K} % 100"),
    "availability_30": _text(f"{K} % 31"),
    "availability_60": _text(f"{K} % 61"),
    "availability_90": _text(f"{K} % 91"),
    "availability_365": _text(f"{K} * 3 % 366"),
    "has_availability": "'t'",
    "number_of_reviews": f"CASE WHEN {UNRATED} THEN '0' ELSE {_text(f'{K} * 7 % 120')} END",
    "number_of_reviews_ltm": _text(f"{K} % 20"),
    "first_review": f"CASE WHEN {UNRATED} THEN NULL ELSE {_day('2015-01-01', f'{K} % 3000')} END",
    "last_review": f"CASE WHEN {UNRATED} THEN NULL ELSE {_day('2023-01-01', f'{K} * 5 % 1100')} END",
    "review_scores_rating": _score(300, 13, 201),
    "review_scores_accuracy": _score(320, 17, 181),
    "review_scores_cleanliness": _score(310, 19, 191),
    "review_scores_checkin": _score(330, 23, 171),
    "review_scores_communication": _score(340, 29, 161),
    "review_scores_location": _score(350, 31, 151),
    "review_scores_value": _score(300, 37, 201, f"{K} % 14 = 6"),
    "reviews_per_month": f"CASE WHEN {UNRATED} THEN NULL ELSE {_hundredths(f'{K} * 11 % 800')} END",
    "license": f"CASE {K} % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'LIC-' || {_text(K)} END",
    "instant_bookable": f"CASE WHEN {SIZE} % 2 = 0 THEN 't' ELSE 'f' END",
}
L_CENTS = "CAST(round(l.l_extendedprice * 100) AS BIGINT)"
L_DISCOUNT = "CAST(round(l.l_discount * 100) AS BIGINT)"
CALENDAR = {
    "city": CITY_OF.format(nk=f"({NATION_OF.format(k='l.l_partkey')})"),
    "listing_id": f"CASE WHEN l.l_quantity = 50 AND l.l_linenumber = 7 THEN '0' ELSE {_text('l.l_partkey + 1')} END",
    "date": "CASE WHEN l.l_quantity = 49 AND l.l_linenumber = 7 THEN 'not-a-date' "
            f"ELSE {_text('CAST(l.l_shipdate AS DATE)')} END",
    "available": "CASE WHEN l.l_quantity = 1 AND l.l_linenumber = 7 THEN NULL WHEN l.l_returnflag = 'N' THEN 't' "
                 "WHEN l.l_returnflag = 'A' THEN 'f' WHEN l.l_linestatus = 'O' THEN 't' ELSE 'f' END",
    "price": f"CASE WHEN l.l_quantity = 2 AND l.l_linenumber = 6 THEN NULL ELSE {_money(L_CENTS)} END",
    "adjusted_price": _money(f"CAST(floor({L_CENTS} * (100 - {L_DISCOUNT}) / 100) AS BIGINT)"),
    "minimum_nights": _text("l.l_linenumber"),
    "maximum_nights": _text("CAST(l.l_quantity AS BIGINT) * 10"),
}
O = "o.o_orderkey"
REVIEWS = {
    "city": CITY_OF.format(nk=f"({NATION_OF.format(k='o.o_custkey')})"),
    "id": _text(f"{O} + 1"),
    "listing_id": _text("o.o_custkey + 1"),
    "date": _text("CAST(o.o_orderdate AS DATE)"),
    "reviewer_id": f"CASE WHEN {O} % 90 = 4 THEN NULL ELSE {_text(f'CAST(floor({O} / 3) AS BIGINT)')} END",
    "reviewer_name": f"'Guest ' || {_text(f'CAST(floor({O} / 3) AS BIGINT) % 50')}",
    "comments": f"CASE WHEN {O} % 40 = 9 THEN NULL ELSE '<b>' || o.o_orderpriority || '</b> &amp; <br/>' || "
                "o.o_orderstatus || ' ' END",
}
NEIGHBOURHOODS = {
    "city": CITY_OF.format(nk="n.n_nationkey"),
    "neighbourhood": "replace(n.n_name, '_', '   ')",
    "neighbourhood_group": "' ' || r.r_name",
}
SOURCES = {
    "listings": (LISTINGS, f"part p JOIN nation n ON n.n_nationkey = {NATION_OF.format(k=K)} "
                           "JOIN region r ON r.r_regionkey = n.n_regionkey"),
    "calendar": (CALENDAR, "lineitem l"),
    "reviews": (REVIEWS, "orders o"),
    "neighbourhoods": (NEIGHBOURHOODS, "nation n JOIN region r ON r.r_regionkey = n.n_regionkey"),
}


def raw_sql(kind: str) -> str:
    columns, source = SOURCES[kind]
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source}"


ROWS_PER_TASK = 20_000  # listings rows parsed by one task


def _spread(spark, path: str, key: str):
    """The rows of a Parquet file over tasks by their number: a row group is one task at most, and a file of few columns has few."""
    df = spark.read.parquet(path)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))  # counted from the file's footer
    return df.repartition(tasks, key)


def raw_table(spark, sf_dir: str, kind: str):
    """The raw table as a DataFrame over the Parquet files in ``sf_dir``.

    A ``part`` row is short but becomes a listing of some 50 derived columns, so these rows are spread before.
    """
    columns, source = SOURCES[kind]
    for name in ("nation", "region", "lineitem", "orders"):
        if f"{name} " in source + " ":
            source = source.replace(f"{name} {name[0]}", f"parquet.`{sf_dir}/{name}.parquet` {name[0]}")
    tables = {}
    if "part p" in source:
        tables["part"] = _spread(spark, f"{sf_dir}/part.parquet", "p_partkey")
        source = source.replace("part p", "{part} p")
    text = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    # braces of the expressions are no fields of the statement
    return spark.sql("SELECT " + (text.replace("{", "{{").replace("}", "}}") if tables else text) + f" FROM {source}", **tables)
