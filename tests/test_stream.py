from staylens.streaming import ingest


def test_each_file_is_taken_once(spark, tmp_path):
    cols = ["id", "listing_id", "date", "reviewer_id", "reviewer_name", "comments"]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def add(rows):
        spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)).coalesce(1).write.mode("append").option("header", True).csv(src)

    def take():
        ingest.ingest(ingest.raw_stream(spark, src, cols), "reviews", out, state)
        return ingest.ingested(spark, out, "reviews").count(), ingest.ingested(spark, out, "reviews", valid=False).count()

    add([("1", "5", "2024-01-01", "7", "A", "<b>ok</b>"), ("2", "0", "2024-01-02", "8", "B", "x")])
    assert take() == (1, 1)
    add([("3", "6", "2024-01-03", "9", "C", "fine")])
    assert take() == (2, 1)
    assert take() == (2, 1)
    assert ingest.ingested(spark, out, "reviews").filter("id = 1").first().comments == "ok"
