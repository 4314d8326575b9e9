"""Profiles of tables that grow by files: distinct values and quartiles from stored sketches, merged run by run.

Each new file is sketched once, in one scan with partial aggregates, and merged with the state the last successful run
left; earlier files are never read again.  A state is one row per column, of a few hundred kilobytes at most.  The
ledger says which state counts, so a run that dies half-way leaves the profile as it was.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rounding import ratio, rows, stable_round
from .ledger import Ledger, latest_state

STAGE = "profile"
HLL_BITS = 14  # relative standard error of distinct counts: 1.04 / sqrt(2^14), below 1 %
KLL_SIZE = 1600  # rank error of quartiles below 0.3 % with 99 % confidence
STATE_SCHEMA = ("column_name string, row_count long, non_null long, value_count long, total double, min_value double, "
                "max_value double, distinct_sketch binary, quantile_sketch binary")
REPORT_SCHEMA = ("column_name string, row_count long, null_count long, unique_count long, unique_pct double, min double, max double, "
                 "mean double, q25 double, median double, q75 double")


def _number(df: DataFrame, name: str) -> Column:
    """The column as double where it is a number other than NaN, else NULL."""
    if not isinstance(df.schema[name].dataType, T.NumericType):
        return F.lit(None).cast("double")
    v = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(v), v)


def sketch(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One state row per column of ``df``, from one scan."""
    names = columns or df.columns
    aggs = []
    for i, c in enumerate(names):
        v = _number(df, c)
        aggs += [F.count(f"`{c}`").alias(f"k{i}"), F.count(v).alias(f"n{i}"), F.sum(v).alias(f"s{i}"), F.min(v).alias(f"lo{i}"),
                 F.max(v).alias(f"hi{i}"), F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), HLL_BITS).alias(f"d{i}"),
                 F.kll_sketch_agg_double(v, KLL_SIZE).alias(f"q{i}")]
    fields = T.StructType.fromDDL(STATE_SCHEMA).names[2:]
    cells = [F.struct(F.lit(c).alias("column_name"), F.col("row_count"), *[F.col(f"{p}{i}").alias(f) for p, f in zip(
        ("k", "n", "s", "lo", "hi", "d", "q"), fields)]) for i, c in enumerate(names)]
    return df.agg(rows().alias("row_count"), *aggs).select(F.inline(F.array(*cells)))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both states as one; a column that one side lacks keeps the other side's values."""
    a, b = old.alias("a"), new.alias("b")

    def both(name: str, join) -> Column:
        x, y = F.col(f"a.{name}"), F.col(f"b.{name}")
        return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(join(x, y)).alias(name)
    add = lambda x, y: x + y
    return a.join(b, F.col("a.column_name") == F.col("b.column_name"), "full").select(
        F.coalesce("a.column_name", "b.column_name").alias("column_name"), *[both(c, add) for c in ("row_count", "non_null", "value_count", "total")],
        both("min_value", F.least), both("max_value", F.greatest), both("distinct_sketch", F.hll_union),
        both("quantile_sketch", F.kll_sketch_merge_double))


def report(state: DataFrame) -> DataFrame:
    """Counts, extremes and mean are exact; distinct values and quartiles are within the sketches' error."""
    unique = F.hll_sketch_estimate("distinct_sketch")
    unique = F.least(unique, F.col("non_null"))
    quartiles = {n: F.when(F.col("value_count") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(p)))
                 for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))}
    return state.select("column_name", "row_count", (F.col("row_count") - F.col("non_null")).alias("null_count"), unique.alias("unique_count"),
                        F.coalesce(stable_round(ratio(unique, "non_null", 100), 2), F.lit(0.0)).alias("unique_pct"),
                        F.col("min_value").alias("min"), F.col("max_value").alias("max"),
                        stable_round(ratio("total", "value_count"), 4).alias("mean"), *[q.alias(n) for n, q in quartiles.items()])


class GrowingProfile:
    """The profile of table ``name``, kept below ``folder`` and recorded in ``ledger``."""

    def __init__(self, spark: SparkSession, folder: str, ledger: Ledger, name: str):
        self.spark, self.folder, self.ledger, self.name = spark, folder, ledger, name

    def _path(self, run_id: str) -> str:
        return f"{self.folder}/{self.name}/run={run_id}"

    def state(self) -> DataFrame | None:
        done = latest_state(self.ledger.events).filter(
            (F.col("status") == "SUCCESS") & (F.col("stage") == STAGE) & (F.col("city") == self.name))
        last = done.orderBy(F.desc("completed_at"), "run_id").first()
        return None if last is None else self.spark.read.schema(STATE_SCHEMA).parquet(self._path(last.run_id))

    def add(self, df: DataFrame, source: str, digest: str, columns: list[str] | None = None) -> bool:
        """Takes in the rows of one file; False where a file of this content has been taken before."""
        if self.ledger.already_processed(source, digest, STAGE, self.name):
            return False
        before = self.state()
        run_id = self.ledger.start(self.name, STAGE, source, digest)
        try:
            fresh = sketch(df, columns)
            (fresh if before is None else merge(before, fresh)).coalesce(1).write.mode("overwrite").parquet(self._path(run_id))
        except Exception as err:
            self.ledger.fail(run_id, str(err))
            raise
        self.ledger.complete(run_id)
        return True

    def report(self) -> DataFrame:
        state = self.state()
        return self.spark.createDataFrame([], REPORT_SCHEMA) if state is None else report(state)
