"""Named queries and guarded ad-hoc SQL over the star tables."""

import re

from pyspark.sql import DataFrame, SparkSession

from . import explore, market

# fixed values: words an ad-hoc statement may not contain, and its row cap
WRITE_WORDS = ["DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "GRANT", "TRUNCATE"]
AD_HOC_ROWS = 50


def query_names() -> list[str]:
    return sorted({**market.NAMED, **explore.NAMED})


def named_query(star: dict[str, DataFrame], name: str, **params) -> DataFrame:
    """The registered query ``name`` over ``star``; parameters go to the query as values, never as SQL text."""
    found = {**market.NAMED, **explore.NAMED}.get(name)
    if found is None:
        raise KeyError(f"unknown query {name!r}; available: {', '.join(query_names())}")
    return found(star, **params)


def check_read_only(sql: str) -> str:
    for word in WRITE_WORDS:
        if re.search(rf"\b{word}\b", sql, re.IGNORECASE):
            raise ValueError(f"{word} is not allowed in an ad-hoc query")
    return sql.strip().rstrip(";").strip()


def ad_hoc_query(spark: SparkSession, star: dict[str, DataFrame], sql: str, rows: int = AD_HOC_ROWS) -> DataFrame:
    """A query over views named like the star tables, at most ``rows`` rows.

    The text is a subquery of ours, so commands do not parse and a limit inside it cannot lift the outer one.  The views
    are dropped when the plan is made, and the caller's own views of these names are put back.
    """
    text = check_read_only(sql)
    own = {name: spark.table(name) for name in star if spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary}
    for name, df in star.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(f"SELECT * FROM (\n{text}\n) LIMIT {int(rows)}")
    finally:
        for name in star:
            spark.catalog.dropTempView(name)
        for name, df in own.items():
            df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, star: dict[str, DataFrame], name: str | None = None, sql: str | None = None,
            **params) -> DataFrame:
    """Exactly one of a query name or a statement."""
    if (name is None) == (sql is None):
        raise ValueError("give either a query name or a statement")
    return named_query(star, name, **params) if name else ad_hoc_query(spark, star, sql)
