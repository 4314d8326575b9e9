"""Helpers shared by the operators: stored intermediate tables, column picking, label splits, connected components."""

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="staylens-llm-")
    return _LOCAL[app]


TEXTS_PER_BATCH = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int | None):
    """Within it, jobs hand at most ``rows`` rows to Python at once (a smaller bound of the session holds); None changes nothing."""
    before = spark.conf.get(_BATCH)
    if rows and not 0 < int(before) <= rows:
        spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def stored(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage with files every executor can reach again.

    ``batch`` bounds the rows that are in a Python worker, and in the buffers to and from it, at once.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/staylens-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    with batches_of(spark, batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; extra or clashing columns of the input never reach an operator."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def split_of(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; an absent id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, mod: int, held: int, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` training documents, the ones with the smallest hashes of their ids.

    Training rows are those whose ``split_of(doc_id, mod)`` is not ``held``.  Repeated labels of an id count as 1
    where any of them is 1.  ``rows`` bounds what a fit ever sees; the ids are a bounded broadcast.
    """
    ids = (labels.select("doc_id", F.col(column).cast("int").alias("label"))
           .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (split_of("doc_id", mod) != held))
           .groupBy("doc_id").agg(F.max("label").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return chosen.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) with the smallest node reachable, for undirected edges (a, b) of longs.

    Alternating large-star and small-star steps on tables, so a component may be of any size: each step is grouped
    minima with partial aggregation, never a list per node.  The edges go to a written table after each round.
    Nodes without an edge do not appear.
    """
    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), name)
    seen = _signature(e)
    for _ in range(rounds if seen[0] else 0):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each neighbour above a node is linked to the smallest node around it
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # small star: a node and its lower neighbours are linked to the smallest of them
        up = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(up, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")
                 .union(up.select(F.col("m").alias("a"), "b")).distinct())
        e = stored(small, name)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
