"""Column builders that turn raw text into typed values; bad input becomes NULL, never an error."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounding import as_col

# fixed values: text patterns and HTML entities
CURRENCY_MARKS = "[$€£,]"
NUMBER = r"(\d+\.?\d*)"
QUOTED = "'[^']+'"
TAG = "<[^>]+>"
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]
APOSTROPHE = ("&#39;", "'")


def to_number(c, kind: str = "double") -> Column:
    """Tolerant cast; integers given with a fraction are rounded half-even first."""
    x = as_col(c)
    if kind in ("int", "bigint", "long"):
        return F.bround(x.try_cast("double"), 0).try_cast("bigint" if kind == "long" else kind)
    return x.try_cast(kind)


def clean_price(c) -> Column:
    return F.trim(F.regexp_replace(as_col(c), CURRENCY_MARKS, "")).try_cast("double")


def price_currency(c) -> Column:
    x = as_col(c)
    found = F.lit(None).cast("string")
    for mark in ("£", "€", "$"):
        found = F.when(x.contains(mark), F.lit(mark)).otherwise(found)
    return found


def true_false(c, lenient: bool = False) -> Column:
    x = F.lower(F.trim(as_col(c))) if lenient else as_col(c)
    return F.when(x == "t", F.lit(True)).when(x == "f", F.lit(False))


def iso_date(c) -> Column:
    return F.try_to_date(as_col(c), "yyyy-MM-dd")


def percent(c) -> Column:
    return F.trim(F.replace(as_col(c), F.lit("%"), F.lit(""))).try_cast("double") / F.lit(100.0)


def bathrooms(c) -> Column:
    x = as_col(c)
    number = F.nullif(F.regexp_extract(x, NUMBER, 1), F.lit("")).try_cast("double")
    return F.coalesce(number, F.when(F.lower(x).contains("half"), F.lit(0.5)))


def bathrooms_shared(c) -> Column:
    return F.lower(as_col(c)).contains("shared")


def amenity_count(c) -> Column:
    """Elements counted by their separators, 0 for NULL and for an empty list."""
    x = as_col(c)
    return F.when(F.length(x) > 2, F.regexp_count(x, F.lit('","')) + 1).otherwise(0).cast("int")


def amenity_list(c) -> Column:
    """Sorted distinct amenities from a JSON array or from ``{a,"b"}`` set notation."""
    x = F.trim(as_col(c))
    from_json = F.from_json(x, "array<string>")
    in_braces = F.when(
        x.startswith("{") & x.endswith("}"),
        F.transform(F.split(F.substring(x, F.lit(2), F.length(x) - 2), ","),
                    lambda s: F.trim(F.regexp_replace(F.trim(s), "^[\"']+|[\"']+$", ""))))
    items = F.when(x.startswith("["), F.transform(from_json, lambda s: F.trim(s))).otherwise(in_braces)
    kept = F.filter(items, lambda s: s.isNotNull() & (s != ""))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


def verification_count(c) -> Column:
    x = as_col(c)
    return F.when(F.length(x) > 2, F.regexp_count(x, F.lit(QUOTED))).otherwise(0).cast("int")


def verification_list(c) -> Column:
    """Sorted entries of a printed list; repeated entries are kept."""
    parts = F.split(F.regexp_replace(F.trim(as_col(c)), "[\\[\\]{}'\"]", ""), ",")
    trimmed = F.transform(parts, lambda s: F.trim(s))
    return F.coalesce(F.array_sort(F.filter(trimmed, lambda s: s != "")), F.array().cast("array<string>"))


def strip_html(c) -> Column:
    x = F.regexp_replace(as_col(c), TAG, "")
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def strip_html_or_null(c) -> Column:
    """As :func:`strip_html`, also decoding apostrophes; text left empty becomes NULL."""
    return F.nullif(F.trim(F.replace(strip_html(c), F.lit(APOSTROPHE[0]), F.lit(APOSTROPHE[1]))), F.lit(""))


def tidy_text(c) -> Column:
    return F.regexp_replace(F.regexp_replace(as_col(c), r"^\s+|\s+$", ""), r"\s{2,}", " ")


def schema_hash(names: list[str]) -> str:
    import hashlib
    return hashlib.md5("|".join(sorted(names)).encode()).hexdigest()


def schema_hash_column(names: Column) -> Column:
    """The same fingerprint for an array column of names."""
    return F.md5(F.array_join(F.array_sort(names), "|"))


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def cast_first(df: DataFrame, candidates: list[str], kind: str) -> Column:
    """First candidate column that exists, tolerantly cast; a typed NULL when none does."""
    name = first_present(df, candidates)
    return F.lit(None).cast(kind) if name is None else _tolerant(df, name, kind)


def coalesce_present(df: DataFrame, candidates: list[str], kind: str) -> Column:
    """First non-NULL value among all candidate columns that exist."""
    present = [_tolerant(df, c, kind) for c in candidates if c in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast(kind)


def _tolerant(df: DataFrame, name: str, kind: str) -> Column:
    have = df.schema[name].dataType.simpleString()
    if have == kind:
        return F.col(name)
    if kind in ("int", "bigint") and have in ("double", "float", "string"):
        return to_number(name, kind)
    return F.col(name).try_cast(kind)
