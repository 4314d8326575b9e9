import os

from pyspark.sql import functions as F

from staylens.operators import star
from staylens.plans import market
from staylens.sources.sinks import write_table


def test_calendar_of_one_city_reads_its_partition(spark, tmp_path, capsys):
    days = spark.sql("SELECT CAST(id % 9 AS bigint) listing_id, IF(id % 9 < 6, 'amsterdam', 'barcelona') city, date_add(DATE '2025-01-01', CAST(id AS int)) full_date, id % 2 = 0 free "
                     "FROM range(300) UNION ALL SELECT NULL, 'amsterdam', DATE '2025-02-02', true")
    calendar = days.select("listing_id", "city", F.col("full_date").alias("date"), F.col("free").alias("available"), F.lit(10.0).alias("price"))
    dates = days.select("full_date").distinct().select("full_date", F.date_format("full_date", "yyyyMMdd").cast("int").alias("date_key"))
    cities = spark.createDataFrame([(1, "amsterdam"), (2, "barcelona")], "city_key int, city_name string")
    snapshot = spark.range(9).select(F.col("id").alias("listing_id"), F.when(F.col("id") < 6, 1).otherwise(2).alias("city_key"), (F.col("id") + 100).alias("listing_key"))
    fact = star.fact_calendar(spark, calendar, snapshot, cities, dates, with_layout=True)
    assert fact.columns[-2:] == list(star.CALENDAR_LAYOUT)
    stored = spark.read.parquet(write_table(fact, str(tmp_path / "fact"), list(star.CALENDAR_LAYOUT)))
    assert stored.count() == 301 and stored.filter("listing_key IS NULL").count() == 1
    files = sum(len([f for f in names if f.endswith(".parquet")]) for _, _, names in os.walk(tmp_path / "fact"))
    assert files == stored.select("fact_city", "fact_month").distinct().count()  # one file each, not one per task
    tables = {"fact_calendar": stored, "dim_date": dates, "fact_listing_snapshot": snapshot}
    narrow = market.temporal_trends(tables, 2)
    narrow.explain()
    assert "PartitionFilters: [isnotnull(fact_city" in capsys.readouterr().out
    plain = {**tables, "fact_calendar": stored.drop("fact_city", "fact_month")}
    assert sorted(narrow.collect()) == sorted(market.temporal_trends(plain, 2).collect()) and narrow.count() == 99  # 33 days for each of three listings


def test_calendar_is_not_counted_before_its_join(spark, monkeypatch):
    from staylens.operators import joins
    monkeypatch.setattr(joins, "checkpointed", lambda df: (_ for _ in ()).throw(AssertionError("counted")))
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k long, v string")
    right = spark.createDataFrame([(1, 10)], "k long, w long")
    got = joins.join_to_unique(left, right, ["k"], hot_rows=None)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", 10), (None, "b", None), (3, "c", None)], key=str)


def test_layers_build_only_the_tables_asked_for(spark, tmp_path):
    from checks import testbed
    from staylens.plans.warehouse import Warehouse
    w = Warehouse(spark, {k: testbed.raw_table(spark, "/root/testdata/sf0.001", k) for k in testbed.SOURCES}, str(tmp_path))
    assert w.silver["neighbourhoods"].count() > 0
    assert [p.name for p in (tmp_path / "flagged").iterdir()] == ["neighbourhoods"]
    assert w.silver["neighbourhoods"] is w.silver["neighbourhoods"] and list(w.silver) == ["neighbourhoods", "listings", "calendar", "reviews"]
    assert {k: df.count() > 0 for k, df in w.flagged.items()} == dict.fromkeys(w.silver, True)
    assert {p.name for p in (tmp_path / "flagged").iterdir()} == set(w.silver)
