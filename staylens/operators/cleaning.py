"""Raw text tables to typed, imputed and flagged silver tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions import parsing as P
from ..sources.readers import blank_tokens_to_null
from ..sources.sinks import split_counts, valid_rows
from .joins import small_side
from .ordering import exact_quantiles
from .quality import validation_flags

KINDS = ["neighbourhoods", "listings", "calendar", "reviews"]

# special parsers: name -> columns they add, given the source column
SPECIAL: dict[str, Callable[[str], dict[str, Column]]] = {
    "parse_bathrooms": lambda c: {"bathrooms": P.bathrooms(c), "bathrooms_shared": P.bathrooms_shared(c)},
    "parse_amenities": lambda c: {"amenity_count": P.amenity_count(c)},
    "parse_list": lambda c: {"host_verification_count": P.verification_count(c)},
    "strip_html": lambda c: {c: P.strip_html(c)},
}
GROUPS: dict[str, Callable[[str], Column]] = {
    "price": P.clean_price, "boolean": P.true_false, "date": P.iso_date, "percentage": P.percent,
    "text": P.tidy_text, "decimal": lambda c: F.col(c).try_cast("double"),
}


def apply_parsers(df: DataFrame, rules: dict, special: dict | None = None) -> DataFrame:
    """All column groups of ``rules`` in one projection; columns that are absent are skipped."""
    special = {**SPECIAL, **(special or {})}
    new: dict[str, Column] = {}
    for group, build in GROUPS.items():
        new.update({c: build(c) for c in rules.get(group, []) if c in df.columns})
    for item in rules.get("integer", []):
        name, kind = item.split(":")
        if name in df.columns:
            new[name] = P.to_number(name, kind)
    for source, parser in rules.get("special", {}).items():
        if source in df.columns and parser in special:
            new.update(special[parser](source))
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns],
                     *[e.alias(c) for c, e in new.items() if c not in df.columns])


def fill_missing(df: DataFrame, strategies: dict[str, dict], within: list[str] | None = None) -> DataFrame:
    """Sentinels, zeros and group medians; imputed columns get a ``_<column>_imputed`` flag.

    Columns imputed over the same groups share one median computation.  ``within`` adds columns (the city)
    to every group.  NULL group keys take no median, as in an equi-join.
    """
    out = df
    plain = {c: s for c, s in strategies.items() if c in df.columns}
    fills = {c: F.coalesce(F.col(c), F.lit(s.get("fill_value", "Unknown")))
             for c, s in plain.items() if s["strategy"] == "sentinel"}
    fills.update({c: F.coalesce(F.col(c), F.lit(0)) for c, s in plain.items() if s["strategy"] == "impute_zero"})
    if fills:
        out = out.withColumns(fills)
    by_groups: dict[tuple, list[str]] = {}
    for c, s in plain.items():
        if s["strategy"] == "impute_median_by_group":
            keys = tuple([*(within or []), *[g for g in s.get("group_columns", []) if g in df.columns]])
            by_groups.setdefault(keys, []).append(c)
    for keys, names in by_groups.items():
        meds = exact_quantiles(out, list(keys), {f"_median_{c}": (c, 0.5) for c in names})
        flags = {f"_{c}_imputed": F.col(c).isNull() for c in names}
        out = out.withColumns(flags)
        if keys:
            # plain equality: a NULL in any group column finds no median
            out = out.join(small_side(meds), list(keys), "left")
            medians = {c: F.col(f"_median_{c}") for c in names}
        else:
            medians = {c: meds.select(f"_median_{c}").scalar() for c in names}
        out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), medians[c]) for c in names})
        out = out.select(*[c for c in df.columns], *[c for c in out.columns
                                                      if c not in df.columns and not c.startswith("_median_")])
    return out


def clean(df: DataFrame, kind: str, rules: dict | None = None, within: list[str] | None = None) -> DataFrame:
    """Parse, fill and flag one raw table; the result holds valid and rejected rows."""
    rules = rules or settings.CLEANING[kind]
    typed = apply_parsers(blank_tokens_to_null(df), rules)
    filled = fill_missing(typed, rules.get("missing", {}), within)
    return validation_flags(filled, rules.get("rules", {}))


def clean_listings(df: DataFrame, within: list[str] | None = None) -> DataFrame:
    return clean(df, "listings", within=within)


def clean_calendar(df: DataFrame) -> DataFrame:
    return clean(df, "calendar")


def clean_reviews(df: DataFrame) -> DataFrame:
    return clean(df, "reviews")


def clean_neighbourhoods(df: DataFrame) -> DataFrame:
    return clean(df, "neighbourhoods")


def clean_all(raw: dict[str, DataFrame], within: list[str] | None = None) -> dict[str, DataFrame]:
    """Flagged tables for every raw table given, neighbourhoods first."""
    return {k: clean(raw[k], k, within=within if k == "listings" else None) for k in KINDS if k in raw}


def cleaning_summary(flagged: dict[str, DataFrame], by: list[str] | None = None) -> DataFrame:
    """Rows in, kept and rejected per table."""
    parts = [split_counts(df, by).select(F.lit(k).alias("file_type"), "*") for k, df in flagged.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def silver(flagged: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {k: valid_rows(df) for k, df in flagged.items()}
