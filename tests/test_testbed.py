"""Raw tables of the registered queries."""

from checks import testbed


def test_listings_of_a_one_row_group_file_are_parsed_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.range(3000).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "'Brand#1' AS p_brand", "'LARGE' AS p_type", "CAST(id % 50 AS INT) AS p_size",
                                 "900.0D + id AS p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("SELECT CAST(id AS INT) AS n_nationkey, concat('N_', id) AS n_name, 0 AS n_regionkey FROM range(25)").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("SELECT 0 AS r_regionkey, 'R' AS r_name").write.parquet(f"{tmp_path}/region.parquet")
    monkeypatch.setattr(testbed, "ROWS_PER_TASK", 100)
    raw = testbed.raw_table(spark, str(tmp_path), "listings")
    assert raw.columns == list(testbed.LISTINGS)
    assert raw.rdd.getNumPartitions() == 30
    assert raw.count() == 3000 and raw.select("listing_url").distinct().count() == 3000
    assert raw.filter("amenities = '{Wifi,\"Washer\"}'").count() == 429  # braces are text
    assert raw.rdd.glom().map(len).reduce(max) < 400
