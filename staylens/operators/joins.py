"""Joins of a large table to a table with one row per key, safe for keys that hold a large share of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import checkpointed

HOT_ROWS = 10_000_000


def join_to_unique(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Left join to ``right``, which has one row per key.

    Rows with a NULL key match nothing; they stay where they are and get NULL columns, so they never meet in one
    partition.  Keys with more than ``hot_rows`` rows are found by a count with partial sums.  Their rows also stay where
    they are and meet a broadcast of just these keys: there are at most rows / ``hot_rows`` of them.  All other rows take
    the ordinary join.  ``hot_rows=None`` is for keys that are nearly unique on the left by their meaning: nothing is
    counted, and what skew there is falls to the adaptive skew join.
    """
    known, absent = F.lit(True), F.lit(False)
    for k in keys:
        known, absent = known & F.col(k).isNotNull(), absent | F.col(k).isNull()
    new = [f for f in right.schema.fields if f.name not in keys]
    out = [*keys, *[c for c in left.columns if c not in keys], *[f.name for f in new]]
    apart = left.filter(absent).withColumns({f.name: F.lit(None).cast(f.dataType) for f in new}).select(*out)
    keyed = left.filter(known)
    if hot_rows is None:
        return keyed.join(right, keys, "left").select(*out).unionByName(apart)
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = checkpointed(counts.select(*keys))
    if hot.isEmpty():
        return keyed.join(right, keys, "left").select(*out).unionByName(apart)
    marked = keyed.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    heavy = marked.filter("_hot").drop("_hot").join(F.broadcast(right.join(F.broadcast(hot), keys, "left_semi")), keys, "left")
    rest = marked.filter("_hot IS NULL").drop("_hot").join(right, keys, "left")
    return heavy.select(*out).unionByName(rest.select(*out)).unionByName(apart)


BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A computed side table, stored once and broadcast when its counted rows allow it.

    The optimizer cannot see the size of an aggregate before it runs, so without the count the large side of the
    join would be shuffled first.
    """
    stored = checkpointed(df)
    return F.broadcast(stored) if stored.count() <= limit else stored
