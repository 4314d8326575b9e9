import datetime as dt

import pytest
from pyspark.sql import functions as F

from staylens import settings
from staylens.operators import cleaning as C
from staylens.operators import quality as Q
from staylens.sources import readers, sinks


def test_missing_strategies(spark):
    df = spark.createDataFrame([("A", None, 1, None), (None, 2.0, None, 3)], "name string, score double, id int, n int")
    out = C.fill_missing(df, {"name": {"strategy": "sentinel", "fill_value": "Unknown"}, "score": {"strategy": "explicit_null"},
                              "id": {"strategy": "reject"}, "n": {"strategy": "impute_zero"}, "absent": {"strategy": "impute_zero"}})
    assert [tuple(r) for r in out.orderBy("name").collect()] == [("A", None, 1, 0), ("Unknown", 2.0, None, 3)]


def test_group_median_and_flag(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None), (None, None)], "g string, x double")
    out = C.fill_missing(df, {"x": {"strategy": "impute_median_by_group", "group_columns": ["g"]}})
    got = sorted(((r.g or "", r.x, r._x_imputed) for r in out.collect()), key=str)
    assert got == sorted([("a", 1.0, False), ("a", 3.0, False), ("a", 2.0, True), ("b", None, True), ("", None, True)], key=str)
    whole = C.fill_missing(df, {"x": {"strategy": "impute_median_by_group", "group_columns": ["nope"]}})
    assert sorted(r.x for r in whole.collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]


def test_flags(spark):
    df = spark.createDataFrame([(10.0, 5.0, "Private room"), (0.0, 95.0, "Tent"), (-5.0, None, None), (None, -91.0, "Hotel room")],
                               "price double, lat double, room string")
    rules = {"price": [{"check": "not_null"}, {"check": "positive"}], "lat": [{"check": "range", "min": -90, "max": 90}],
             "room": [{"check": "enum", "values": settings.ROOM_TYPES}, {"check": "positive"}], "gone": [{"check": "not_null"}]}
    out = Q.validation_flags(df, rules).collect()
    assert [r._validation_flags for r in out] == ["", "lat_range|price_positive|room_enum", "price_positive", "lat_range|price_not_null"]
    assert [r._is_valid for r in out] == [True, False, False, False]
    free = Q.validation_flags(df, {}, {"cheap": F.col("price") < 5})
    assert [r._validation_flags for r in free.collect()] == ["", "cheap", "cheap", ""]
    assert all(r._is_valid for r in Q.validation_flags(df, {}).collect())


def test_clean_calendar_end_to_end(spark):
    raw = spark.createDataFrame([("1", "2024-01-01", "t", "$1,000.00", "", "2", "30"), ("0", "bad", "x", None, None, None, None)],
                                "listing_id string, date string, available string, price string, adjusted_price string, "
                                "minimum_nights string, maximum_nights string")
    good, bad = C.clean_calendar(raw).orderBy("listing_id").collect()[::-1]
    assert (good.listing_id, good.date, good.available, good.price, good.adjusted_price, good.minimum_nights) == (
        1, dt.date(2024, 1, 1), True, 1000.0, None, 2)
    assert bad._validation_flags == "date_not_null|listing_id_positive" and bad.available is None


def test_split_keeps_every_row(spark, tmp_path):
    flagged = Q.validation_flags(spark.range(10).select(F.col("id").alias("x")), {"x": [{"check": "positive"}]})
    counts = sinks.write_split(flagged, str(tmp_path), "t")
    assert counts == {"input_rows": 10, "output_rows": 9, "rejected_rows": 1}
    good, bad = (sinks.read_split(spark, str(tmp_path), "t", flagged.schema, v) for v in (True, False))
    assert good.columns == ["x"] and good.count() == 9
    assert [tuple(r) for r in bad.collect()] == [(0, "x_positive", False)]


def test_raw_csv(spark, tmp_path):
    import gzip
    text = 'id,name,price\n1,"a, ""b""\nnext",$1.00\n2,NA,N/A\n3,x\n4,y,$2,extra\n'
    with gzip.open(tmp_path / "listings.csv.gz", "wt") as f:
        f.write(text)
    rows = readers.read_raw(spark, str(tmp_path / "listings.csv.gz"), spread=3).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", 'a, "b"\nnext', "$1.00"), ("2", None, None), ("3", "x", None), ("4", "y", "$2")]


def test_sources_prefer_gzip(spark, tmp_path):
    for name in ("listings.csv", "listings.csv.gz", "reviews.csv", "notes.csv"):
        (tmp_path / name).write_text("a\n1\n")
    got = {r.base: (r.path.rsplit("/", 1)[1], r.file_type) for r in readers.resolve_sources(readers.list_files(spark, str(tmp_path))).collect()}
    assert got == {"listings": ("listings.csv.gz", "listings"), "reviews": ("reviews.csv", "reviews"), "notes": ("notes.csv", "unknown")}


def test_geojson(spark, tmp_path):
    (tmp_path / "n.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"neighbourhood":"A"},'
                                        '"geometry":{"type":"Point","coordinates":[1.0,2.0]}}]}')
    row = readers.read_geojson(spark, str(tmp_path / "n.geojson")).first()
    assert row.neighbourhood == "A" and row.geometry.type == "Point"


def test_optional_input(spark, tmp_path):
    assert readers.read_optional(spark, str(tmp_path / "gone")) is None
    assert readers.read_optional(spark, str(tmp_path / "gone"), "a int").count() == 0


@pytest.mark.parametrize("rules, violations", [
    ({"not_null": True}, {"not_null": 1}), ({"unique": True}, {"unique": 1}), ({"positive": True}, {"positive": 2}),
    ({"range": {"min": 1, "max": 3}}, {"range": 3}), ({"regex": "a"}, {})])
def test_column_rules(spark, rules, violations):
    df = spark.createDataFrame([(1,), (2,), (2,), (-1,), (0,), (9,), (None,)], "x int")
    got = {r.rule: r.violations for r in Q.rule_report(df, {"x": rules}).collect()}
    assert got == violations


def test_enum_regex_examples_and_missing(spark):
    df = spark.createDataFrame([("t",), ("f",), ("maybe",), (None,)], "a string")
    got = {r.rule: r for r in Q.rule_report(df, {"a": {"enum": ["t", "f"], "regex": "^[tf]$"}, "b": {"not_null": True}}, examples=True).collect()}
    assert got["enum"].violations == 1 and got["enum"].unexpected == ["maybe"] and got["regex"].violations == 1
    assert not got["exists"].passed


def test_duplicates_and_artifacts(spark):
    df = spark.createDataFrame([(1, "<br>html tag"), (2, "clean"), (2, "cafÃ©"), (3, None)], "id int, text string")
    d = Q.duplicate_report(df, ["id"]).first()
    assert (d.total_rows, d.unique_keys, d.duplicate_keys, d.duplicate_rows) == (4, 3, 1, 1)
    assert not Q.duplicate_report(df, ["nope"]).first().checked
    a = Q.artifact_report(df).first()
    assert (a.html_tags, a.encoding_artifacts) == (1, 1)
