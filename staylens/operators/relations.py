"""Primary keys, references between tables, rows per key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions.rounding import ratio, rows, stable_round
from .distribution import rows_union
from .ordering import exact_quantiles, join_groups


def primary_key_report(df: DataFrame, keys: list[str], name: str = "") -> DataFrame:
    """Rows, distinct keys, NULLs in key columns, and whether the key holds."""
    present = [k for k in keys if k in df.columns]
    if not present:
        return df.sparkSession.createDataFrame(
            [(name, ",".join(keys), None, None, None, None, False)],
            "file_type string, key_columns string, total_rows long, unique_keys long, duplicate_keys long, "
            "null_keys long, valid boolean")
    # distinct keys by grouping, so NULL counts as a key value and no row list is built
    per_key = df.groupBy(*present).agg(rows().alias("_n"))
    has_null = F.lit(False)
    for k in present:
        has_null = has_null | F.col(k).isNull()
    out = per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), rows().alias("unique_keys"),
                      F.coalesce(F.sum(F.when(has_null, F.col("_n"))), F.lit(0)).alias("null_keys"))
    return out.select(F.lit(name).alias("file_type"), F.lit(",".join(present)).alias("key_columns"), "total_rows",
                      "unique_keys", (F.col("total_rows") - F.col("unique_keys")).alias("duplicate_keys"), "null_keys",
                      ((F.col("total_rows") == F.col("unique_keys")) & (F.col("null_keys") == 0)).alias("valid"))


def _key_rows(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(rows().alias("child_rows"))


def matched_keys(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Distinct child keys found among the parent keys."""
    return _key_rows(child, child_key).join(parent.select(F.col(parent_key).alias("key")), "key", "left_semi").select("key")


def orphan_keys(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Distinct child keys without a parent, with the number of rows that hold them."""
    return _key_rows(child, child_key).join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def orphan_examples(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, top: int = 10) -> DataFrame:
    return orphan_keys(parent, child, parent_key, child_key).select("key").orderBy("key").limit(top)


def reference_report(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, name: str = "") -> DataFrame:
    """Coverage of a foreign key: both key sets meet once, after the child rows were counted per key."""
    p = parent.filter(F.col(parent_key).isNotNull()).select(F.col(parent_key).alias("key")).distinct().withColumn("_p", F.lit(True))
    both = _key_rows(child, child_key).join(p, "key", "full_outer")
    in_p, in_c = F.col("_p").isNotNull(), F.col("child_rows").isNotNull()
    orphan = in_c & ~in_p
    out = both.agg(F.count_if(in_p).alias("parent_unique_values"), F.count_if(in_c).alias("child_unique_values"),
                   F.count_if(in_p & in_c).alias("matched_values"), F.count_if(orphan).alias("orphan_values"),
                   F.coalesce(F.sum(F.when(orphan, F.col("child_rows"))), F.lit(0)).alias("orphan_rows"))
    covered = F.when(F.col("child_unique_values") > 0,
                     stable_round(ratio("matched_values", "child_unique_values", 100), 2)).otherwise(F.lit(100.0))
    return out.select(F.lit(name).alias("relationship"), "*", covered.alias("coverage_pct"),
                      (F.col("orphan_values") == 0).alias("is_valid"))


def rows_per_key(df: DataFrame, key: str, name: str = "") -> DataFrame:
    """Mean, median, smallest and largest number of rows per key; keys with more than one row."""
    counts = df.groupBy(key).agg(rows().alias("n"))
    out = counts.agg(stable_round(F.avg("n"), 1).alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"),
                     rows().alias("keys"), F.count_if(F.col("n") > 1).alias("multi_row_keys"))
    return join_groups(out, exact_quantiles(counts, [], {"median": ("n", .5)}), []).select(
        F.lit(name).alias("statistic"), "mean", "median", "min", "max", "keys", "multi_row_keys")


def relationship_report(tables: dict[str, DataFrame], relations: list[tuple] = settings.RELATIONS) -> dict[str, DataFrame]:
    """Key report per table, reference report per relation (skipped where a table is absent), rows per key."""
    keys = [primary_key_report(tables[k], cols, k) for k, cols in settings.PRIMARY_KEYS.items() if k in tables]
    refs = []
    for name, parent, pk, child, fk in relations:
        lacking = [t for t in (parent, child) if t not in tables]
        if lacking:
            some = next(iter(tables.values()))
            refs.append(some.sparkSession.createDataFrame([(name, f"missing: {','.join(lacking)}")],
                                                          "relationship string, skipped string"))
        else:
            refs.append(reference_report(tables[parent], tables[child], pk, fk, name))
    stats = [rows_per_key(tables[k], c, n) for n, k, c in (
        ("calendar_per_listing", "calendar", "listing_id"), ("reviews_per_listing", "reviews", "listing_id"),
        ("listings_per_host", "listings", "host_id")) if k in tables and c in tables[k].columns]
    return {"primary_keys": rows_union(keys), "references": rows_union(refs), "rows_per_key": rows_union(stats)}


def wider_table(candidates: list[DataFrame]) -> DataFrame:
    """Of several files of one type the one with more columns (the detailed one)."""
    return max(candidates, key=lambda df: len(df.columns))
