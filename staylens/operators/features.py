"""Reproducible feature matrix: flags, distances, interactions, imputation, encoding, splits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions.geo import with_centre_distance
from ..functions.rounding import rows
from .distribution import trim_at
from .joins import small_side
from .ordering import checkpointed, exact_quantiles, positions

TARGET = "price_usd"


def feature_rows(star: dict[str, DataFrame]) -> DataFrame:
    """Listings with a positive USD price and all columns features are made from."""
    cities = star["dim_city"].select("city_key", F.col("display_name").alias("city"), F.col("city_name"))
    props = star["dim_property"].select("property_key", "room_type", "property_type", "accommodates", "bedrooms", "beds",
                                        "bathrooms", "amenities", "amenity_count", "instant_bookable")
    areas = star["dim_neighbourhood"].select("neighbourhood_key", "neighbourhood_group")
    hosts = star["dim_host"].select("host_key", "host_is_superhost", "host_identity_verified", "host_response_time",
                                    "host_response_rate", "host_listings_count", "is_professional_host")
    facts = star["fact_listing_snapshot"].filter(F.col(TARGET) > 0).drop("is_professional_host")
    out = (facts.join(cities, "city_key").join(props, "property_key").join(areas, "neighbourhood_key").join(hosts, "host_key"))
    return out.withColumnRenamed("city_key", "_ck").withColumnRenamed("city_name", "city_key").drop(
        "_ck", "host_key", "property_key", "neighbourhood_key", "snapshot_date_key", "listing_key")


def amenity_flags(df: DataFrame, column: str = "amenities", flags: dict[str, list[str]] = settings.AMENITY_FLAGS) -> DataFrame:
    """0/1 columns: any keyword occurs in the joined, lower-cased amenity text (plain substring)."""
    text = F.lower(F.coalesce(F.array_join(F.from_json(F.col(column), "array<string>"), " "), F.col(column)))
    src = df.withColumn("_text", text)

    def hit(words: list[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.col("_text").contains(w)
        return F.coalesce(found, F.lit(False)).cast("int")

    return src.withColumns({name: hit(words) for name, words in flags.items()}).drop("_text")


def interactions(df: DataFrame, pairs: list[tuple[str, str]] = settings.INTERACTIONS) -> DataFrame:
    """Products of two features with NULL taken as 0; pairs with an absent column are skipped."""
    def value(c):
        return F.coalesce(F.col(c), F.lit(0))
    new = {f"{a}_x_{b}": value(a) * value(b) for a, b in pairs if a in df.columns and b in df.columns}
    return df.withColumns(new) if new else df


def impute(df: DataFrame, numeric: list[str], boolean: list[str] = [], categorical: list[str] = [],
           indicators: bool = True) -> tuple[DataFrame, list[str]]:
    """Medians, false and a placeholder; columns that have gaps get an ``is_missing_`` indicator."""
    numeric = [c for c in numeric if c in df.columns]
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first().asDict() if numeric else {}
    holes = [c for c in numeric if gaps[c]]
    new: dict[str, Column] = {}
    flags = [f"is_missing_{c}" for c in holes] if indicators else []
    if holes:
        med = exact_quantiles(df, [], {c: (c, 0.5) for c in holes}).first()
        if indicators:
            new.update({f"is_missing_{c}": F.col(c).isNull().cast("int") for c in holes})
        new.update({c: F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in holes})
    new.update({c: F.coalesce(F.col(c), F.lit(False)).cast("int") for c in boolean if c in df.columns})
    new.update({c: F.coalesce(F.col(c).cast("string"), F.lit(settings.MISSING_CATEGORY)) for c in categorical if c in df.columns})
    return (df.withColumns(new) if new else df), flags


def top_categories(df: DataFrame, column: str, cap: int) -> list[str]:
    """The ``cap`` most frequent values, name order on ties; a list bounded by ``cap``."""
    got = (df.groupBy(F.col(column).cast("string").alias("v")).agg(rows().alias("n"))
           .orderBy(F.desc("n"), "v").limit(cap + 1).collect())
    return [r.v for r in got]


def one_hot(df: DataFrame, columns: list[str], cap: int | None = settings.MAX_CARDINALITY, min_rows: int = 0,
            prefix: dict[str, str] | None = None) -> tuple[DataFrame, list[str]]:
    """0/1 columns for the most frequent values; the rest share one, the first in name order is left out.

    With ``min_rows`` only values held by that many rows keep their column.  ``cap=None`` merges nothing and
    fails if a column would give more than ``settings.MAX_DUMMIES`` values.
    """
    made: list[str] = []
    exprs: list[Column] = []
    present = [c for c in columns if c in df.columns]
    for c in present:
        if cap is None:
            n = df.groupBy(F.col(c).cast("string").alias("v")).agg(rows().alias("n")).filter("v IS NOT NULL")
            first = n.agg(F.min("v")).first()[0]
            held = n.filter((F.col("n") >= min_rows) & (F.col("v") != F.lit(first))).limit(settings.MAX_DUMMIES + 1).collect()
            if len(held) > settings.MAX_DUMMIES:
                raise ValueError(f"{c} has more than {settings.MAX_DUMMIES} values; give a cap or a larger min_rows")
            for v in sorted(r.v for r in held):
                made.append(f"{(prefix or {}).get(c, c)}_{v}")
                exprs.append(F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)).alias(made[-1]))
            continue
        found = top_categories(df, c, cap)
        top, more = [v for v in found[:cap] if v is not None], len(found) > cap
        value = F.when(F.col(c).isin(top), F.col(c).cast("string")).otherwise(F.lit(settings.OTHER_CATEGORY)) if more else F.col(c).cast("string")
        levels = sorted(top + ([settings.OTHER_CATEGORY] if more else []))[1:]
        if min_rows:
            counts = {r.v: r.n for r in df.groupBy(value.alias("v")).agg(rows().alias("n")).filter(F.col("n") >= min_rows).limit(cap + 1).collect()}
            levels = [v for v in levels if v in counts]
        for v in levels:
            name = f"{(prefix or {}).get(c, c)}_{v}"
            made.append(name)
            exprs.append(F.coalesce((value == v).cast("int"), F.lit(0)).alias(name))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in present], *exprs), made


def with_price_quintile(df: DataFrame, price: str = TARGET, name: str = "price_quintile") -> DataFrame:
    """Q1..Q5 by right-closed quantile edges."""
    cut = exact_quantiles(df, [], {f"e{i}": (price, i / 5) for i in range(1, 5)}).first()
    x = F.col(price)
    label = F.lit("Q5")
    for i in range(4, 0, -1):
        label = F.when(x <= F.lit(cut[f"e{i}"]), f"Q{i}").otherwise(label)
    return df.withColumn(name, F.when(x.isNotNull(), label))


def with_target(df: DataFrame, price: str = TARGET, prob: float = 0.99) -> DataFrame:
    """Rows up to the quantile, with ``target`` = log1p(price)."""
    return trim_at(df.filter(F.col(price) > 0), price, prob).withColumn("target", F.log1p(price))


def from_target(c: Column | str) -> Column:
    """Price from a log-scale value, never negative."""
    return F.greatest(F.expm1(F.col(c) if isinstance(c, str) else c), F.lit(0.0))


META = ["city", "city_key", "room_type", "neighbourhood_group", "is_professional_host", "host_is_superhost"]


def feature_matrix(star: dict[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    """``listing_id``, ``target``, ``meta_*`` columns and the numeric feature columns with their names."""
    # written once: quintiles, medians and category lists are separate passes over the same joined rows
    rows_in = checkpointed(with_target(feature_rows(star)))
    base = with_price_quintile(rows_in).withColumn("has_reviews", (F.col("number_of_reviews") > 0).cast("int"))
    return matrix_of(base)


def matrix_of(base: DataFrame) -> tuple[DataFrame, list[str]]:
    have = set(base.columns)
    numeric = [c for c in settings.NUMERIC_FEATURES if c in have]
    boolean = [c for c in settings.BOOLEAN_FEATURES if c in have]
    categorical = [c for c in settings.CATEGORICAL_FEATURES if c in have]
    meta = [c for c in [*META, "price_quintile", "has_reviews"] if c in have]
    df = base.select("*", *[F.col(c).alias(f"meta_{c}") for c in meta])
    df = amenity_flags(df) if "amenities" in have else df
    flags = list(settings.AMENITY_FLAGS) if "amenities" in have else []
    df = with_centre_distance(df, settings.CITY_CENTRES, "city_key", "latitude", "longitude")
    df = interactions(df)
    crossed = [c for c in df.columns if "_x_" in c]
    df, missing = impute(df, [*numeric, "distance_to_centre_km", *crossed], boolean, categorical)
    df, dummies = one_hot(df, categorical)
    names = [*numeric, *boolean, *flags, "distance_to_centre_km", *crossed, *missing, *dummies]
    names = [c for c in names if c not in settings.LEAKAGE_COLUMNS]
    return df.select("listing_id", "target", *[f"meta_{c}" for c in meta],
                     *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in names]), names


# ---- splits ---------------------------------------------------------------------------------------
def _strata(df: DataFrame, by: list[str]) -> DataFrame:
    label = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in by])
    src = df.withColumn("_stratum", label)
    small = src.groupBy("_stratum").agg(rows().alias("_n")).filter("_n < 2").select("_stratum", F.lit(True).alias("_rare"))
    return src.join(small_side(small), "_stratum", "left").withColumn(
        "_stratum", F.when(F.col("_rare"), F.lit(settings.RARE_STRATUM)).otherwise(F.col("_stratum"))).drop("_rare")


def _shuffled(df: DataFrame, key: str, seed: int) -> list:
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]


def stratified_split(df: DataFrame, key: str, by: list[str], share: float = settings.TEST_SHARE,
                     seed: int = settings.SPLIT_SEED) -> DataFrame:
    """Adds ``is_test``: exactly round(share x size) rows of every stratum, chosen by hash order of the key."""
    src = _strata(df, by)
    sizes = src.groupBy("_stratum").agg(rows().alias("_size"))
    placed = positions(src.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))), ["_stratum"], ["_h", key], "_at")
    return placed.join(small_side(sizes), "_stratum").withColumn(
        "is_test", F.col("_at") <= F.floor(F.col("_size") * F.lit(share) + 0.5)).drop("_stratum", "_h", "_at", "_size")


def stratified_folds(df: DataFrame, key: str, by: list[str], folds: int = settings.FOLDS, seed: int = settings.SPLIT_SEED,
                     name: str = "fold") -> DataFrame:
    """Adds fold numbers 0..k-1, dealt in hash order inside each stratum."""
    src = _strata(df, by).withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"fold{seed}"))))
    placed = positions(src, ["_stratum"], ["_h", key], "_at")
    return placed.withColumn(name, ((F.col("_at") - 1) % folds).cast("int")).drop("_stratum", "_h", "_at")


def regression_columns(star: dict[str, DataFrame], numeric: list[str], boolean: list[str], min_rows: int = 50) -> tuple[DataFrame, list[str]]:
    """Columns of the price regression: numbers, flags, room and city dummies, area dummies with enough rows."""
    base = trim_at(feature_rows(star), "price_local", 0.99)
    base = base.withColumns({c: F.coalesce(F.col(c), F.lit(False)).cast("int") for c in boolean})
    df, rooms = one_hot(base, ["room_type", "city"], cap=None, prefix={"room_type": "room"})
    df, areas = one_hot(df, ["neighbourhood_group"], cap=None, min_rows=min_rows, prefix={"neighbourhood_group": "nbhd"})
    return df, [*numeric, *boolean, *rooms, *areas]
