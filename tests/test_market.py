"""Enrichment, star schema and ledger on the small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from staylens.operators import enrich as E
from staylens.operators import ledger as L
from staylens.operators import star as T
from staylens.plans import market
from staylens.plans.registry import check_read_only, run_sql

D = dt.date
CITIES = {"test_city": {"display_name": "Test City", "country": "testland", "currency_code": "USD", "currency_symbol": "$",
                        "timezone": "UTC", "scrape_date": "2026-01-31"}}


@pytest.fixture(scope="module")
def silver(spark):
    listings = spark.createDataFrame(
        [(1, 10, D(2020, 1, 1), 3, "Central", 100.0, 1, 2, 100, D(2025, 1, 1), D(2026, 1, 1), 2, 4.8),
         (2, 20, D(2021, 1, 1), 1, "West", 200.0, 0, 4, 0, None, D(2020, 1, 1), 0, 4.2)],
        "id long, host_id long, host_since date, host_listings_count int, neighbourhood_cleansed string, price double, bedrooms int, "
        "accommodates int, availability_365 int, first_review date, last_review date, number_of_reviews int, review_scores_rating double")
    calendar = spark.createDataFrame(
        [(1, D(2026, 2, 1), True, 100.0, 1, 30), (1, D(2026, 2, 2), False, 120.0, 1, 30), (2, D(2026, 2, 1), False, 200.0, 2, 60),
         (2, D(2026, 2, 2), False, None, 2, 60)],
        "listing_id long, date date, available boolean, price double, minimum_nights int, maximum_nights int")
    reviews = spark.createDataFrame([(1, D(2026, 1, 1), 500, "great"), (1, D(2026, 1, 2), None, "fine stay"), (2, D(2026, 1, 2), 501, None)],
                                    "listing_id long, date date, reviewer_id long, comments string")
    areas = spark.createDataFrame([("Central", "Inner"), ("West", None)], "neighbourhood string, neighbourhood_group string")
    return {k: v.withColumn("city", F.lit("test_city")) for k, v in
            {"listings": listings, "calendar": calendar, "reviews": reviews, "neighbourhoods": areas}.items()}


@pytest.fixture(scope="module")
def gold(silver):
    return E.enrich(silver["listings"], silver["calendar"], silver["reviews"], silver["neighbourhoods"], CITIES)


def test_enrich(gold):
    a, b = gold.orderBy("id").collect()
    assert (a.days_booked, b.days_booked) == (1, 2) and (a.occupancy_rate_pct, b.occupancy_rate_pct) == (50.0, 100.0)
    assert (a.price_local, a.price_usd, b.price_usd) == (100.0, 100.0, 200.0)
    assert (a.is_professional_host, b.is_professional_host) == (True, False)
    assert (a.price_per_bedroom, b.price_per_bedroom) == (100.0, None) and (a.is_active, b.is_active) == (True, False)
    assert a.unique_reviewers == 2 and b.avg_comment_length is None and a.neighbourhood_group == "Inner"
    assert b.estimated_annual_revenue == 200.0 and a.host_tenure_years == round(2222 / 365.25, 2)


def test_coverage(gold):
    c = E.join_coverage(gold).first()
    assert (c.calendar_coverage_pct, c.reviews_coverage_pct, c.neighbourhood_coverage_pct) == (100.0, 100.0, 100.0)


def test_no_booked_day_sums_to_zero(spark):
    df = spark.createDataFrame([(1, True, 5.0)], "listing_id long, available boolean, price double")
    r = E.calendar_by_listing(df).first()
    assert (r.estimated_annual_revenue, r.avg_booked_price, r.occupancy_rate_pct) == (0.0, None, 0.0)
    with pytest.raises(ValueError):
        E.calendar_by_listing(df.drop("available"))


def test_missing_events_give_warnings(silver):
    assert E.enrichment_warnings(None, None) == ["calendar_missing", "reviews_missing"]
    only = E.enrich(silver["listings"], None, None, None, CITIES)
    assert "total_days" not in only.columns and only.count() == 2


def test_unify(spark):
    a = spark.createDataFrame([(1, "x", 10.0)], "listing_id long, city string, price_usd double")
    b = spark.createDataFrame([(2, "y", "e")], "listing_id int, city string, extra string")
    out = E.unify([a, b])
    assert out.columns == ["city", "extra", "listing_id", "price_usd"] and out.count() == 2
    assert out.filter("city = 'y'").first().price_usd is None and dict(out.dtypes)["listing_id"] == "bigint"
    with pytest.raises(ValueError):
        E.unify([a])


@pytest.fixture(scope="module")
def star(spark, gold, silver):
    reviews = silver["reviews"].withColumn("review_id", F.monotonically_increasing_id()).withColumn("reviewer_name", F.lit("R"))
    return T.build_star(spark, gold, silver["calendar"], reviews, config=CITIES)


def test_star_counts(star):
    got = {r.table_name: r.row_count for r in T.table_counts(star).collect()}
    assert got == {"dim_date": 2222 + 3, "dim_city": 1, "dim_host": 2, "dim_property": 2, "dim_neighbourhood": 2, "dim_reviewer": 2,
                   "fact_listing_snapshot": 2, "fact_calendar": 4, "fact_review": 3} | {"dim_date": got["dim_date"]}
    assert got["dim_date"] == (D(2026, 2, 2) - D(2026, 1, 1)).days + 1
    assert star["fact_calendar"].filter("listing_key IS NULL OR date_key IS NULL").count() == 0


def test_star_needs_gold(spark):
    with pytest.raises(FileNotFoundError):
        T.build_star(spark, None, None, None)


def test_queries_run_by_name(spark, star):
    row = run_sql(spark, star, name="executive_kpis", city_key=1).first()
    assert row.total_listings == 2 and row.avg_daily_rate_usd == 150.0 and row.professional_host_pct == 50.0
    assert market.market_overview(star).first().city == "Test City"
    assert run_sql(spark, star, sql="SELECT count(*) AS n FROM fact_review;").first().n == 3
    with pytest.raises(KeyError):
        run_sql(spark, star, name="nope")
    with pytest.raises(ValueError):
        run_sql(spark, star)


@pytest.mark.parametrize("text", ["drop table x", "SELECT 1; DELETE FROM y", "insert into z values (1)", "Truncate table t"])
def test_writes_are_refused(text):
    with pytest.raises(ValueError):
        check_read_only(text)


def test_ad_hoc_rows_are_capped(spark, star):
    assert run_sql(spark, star, sql="SELECT explode(sequence(1, 500)) AS x").count() == 50
    assert check_read_only("SELECT updated_at FROM t") == "SELECT updated_at FROM t"


def test_ledger(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path))
    run = led.start("paris", "clean", "listings.csv", "h1")
    assert not led.already_processed("listings.csv", "h1")
    led.complete(run, 10, 9, 1)
    state = led.recent().first()
    assert (state.status, state.rows_input, state.rows_output, state.rows_rejected) == ("SUCCESS", 10, 9, 1)
    assert led.already_processed("listings.csv", "h1", "clean", "paris") and not led.already_processed("listings.csv", "h2")
    led.record_lineage(run, "silver", ["listings.csv"], ["clean"])
    assert led.lineage("silver").first().source_files == "listings.csv" and led.lineage("other").count() == 0
    led.record_schema("listings", ["a", "b"], run)
    led.record_schema("listings", ["b", "a"], run)
    led.record_schema("listings", ["a", "c"], run)
    drift = L.schema_drift(led.history).orderBy("captured_at").collect()
    assert [r.changed for r in drift] == [False, False, True] and (drift[2].added, drift[2].removed) == ("c", "b")
    assert len(drift[0].schema_hash) == 32


def test_failed_stage_stops_the_city(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path))
    got = L.run_stages(led, "x", [("a", "f", "h", lambda: (1, 1, 0)), ("b", None, None, lambda: 1 / 0), ("c", None, None, lambda: (1, 1, 0))])
    assert [g["status"] for g in got] == ["SUCCESS", "FAILED"]
    assert L.run_stages(led, "x", [("a", "f", "h", lambda: (1, 1, 0))])[0]["status"] == "SKIPPED"
    assert led.recent(stage="b").first().error_message == "division by zero"


def test_ad_hoc_keeps_the_callers_views(spark, star):
    name = sorted(star)[0]
    spark.range(3).createOrReplaceTempView(name)
    try:
        run_sql(spark, star, sql=f"SELECT count(*) AS n FROM {name}").collect()
        assert spark.table(name).columns == ["id"] and spark.table(name).count() == 3
    finally:
        spark.catalog.dropTempView(name)
    run_sql(spark, star, sql=f"SELECT count(*) AS n FROM {name}").collect()
    assert not spark.catalog.tableExists(name)


def test_star_tables_are_built_when_asked_for(spark, gold, silver, star, tmp_path, monkeypatch):
    reviews = silver["reviews"].withColumn("review_id", F.monotonically_increasing_id()).withColumn("reviewer_name", F.lit("R"))
    real, made = T.fact_calendar, []
    monkeypatch.setattr(T, "fact_calendar", lambda *a: made.append(a) or real(*a))
    tables = T.StarTables(spark, gold, silver["calendar"], reviews, str(tmp_path), CITIES)
    assert tables["dim_city"].count() == 1 and sorted(p.name for p in tmp_path.iterdir()) == ["dim_city"]
    assert sorted(tables["fact_listing_snapshot"].collect()) == sorted(star["fact_listing_snapshot"].collect())
    assert not made and not (tmp_path / "dim_reviewer").exists() and "fact_calendar" in tables
    assert sorted(T.table_counts(tables).collect()) == sorted(T.table_counts(star).collect()) and len(made) == 1
