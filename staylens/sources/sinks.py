"""Writers: split silver output, overwritten tables, JSON reports."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

INTERNAL_PREFIX = "_"


def public_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(INTERNAL_PREFIX)]


def valid_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter("_is_valid").select(*public_columns(flagged))


def rejected_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter(~F.col("_is_valid"))


def split_counts(flagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows in, kept and rejected, with the rejection rate."""
    from ..functions.rounding import ratio, stable_round
    bad = F.count_if(~F.col("_is_valid"))
    return flagged.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(F.col("_is_valid")).alias("output_rows"),
        bad.alias("rejected_rows"), stable_round(ratio(bad, F.count(F.lit(1)), 100), 2).alias("rejection_pct"))


def write_split(flagged: DataFrame, path: str, name: str, by: list[str] | None = None) -> dict[str, int]:
    """Valid and rejected rows as two partitions of one table, written in one pass; the counts come with the write."""
    seen = Observation(f"split {name}")
    (flagged.observe(seen, F.count(F.lit(1)).alias("input"), F.count_if("_is_valid").alias("valid"))
     .write.mode("overwrite").partitionBy("_is_valid", *(by or [])).parquet(f"{path}/{name}"))
    counts = seen.get
    return {"input_rows": counts["input"], "output_rows": counts["valid"],
            "rejected_rows": counts["input"] - counts["valid"]}


def read_split(spark: SparkSession, path: str, name: str, schema: StructType, valid: bool | None = True) -> DataFrame:
    """Rows of one side (or both with ``valid=None``); the other side's files are not touched.

    ``schema`` is that of the flagged table.  Flags are kept for rejected rows and dropped for valid ones.
    """
    df = spark.read.schema(schema).parquet(f"{path}/{name}").select(*schema.names)
    if valid is None:
        return df
    return valid_rows(df) if valid else rejected_rows(df)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    """Overwrites ``path``; with ``by`` rows are first brought together by partition.

    The rebalancing splits a partition value that holds very many rows over several tasks and puts small ones together,
    so the number of files follows the data and not tasks times partition values.
    """
    df = df.hint("rebalance", *by) if by else df
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def save_table(df: DataFrame, name: str, by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite").format("parquet")
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)
    return name


def write_report(df: DataFrame, path: str) -> str:
    """A report table as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path
