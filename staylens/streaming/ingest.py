"""Incremental silver ingest: each new raw file is cleaned once and appended."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import clean
from ..operators.ordering import ensure_checkpoint_dir
from ..sources.readers import has_free_text


def raw_stream(spark: SparkSession, folder: str, columns: list[str], files_per_batch: int | None = 1,
               fmt: str = "csv") -> DataFrame:
    """New raw files below ``folder`` as a stream of text columns.

    One file per batch unless said otherwise: medians that fill gaps are then those of the file, whatever else has arrived.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", has_free_text(columns)).option("escape", '"')
    return reader.format(fmt).load(folder)


def ingest(stream: DataFrame, kind: str, target: str, checkpoint: str, within: list[str] | None = None) -> None:
    """Process everything that is new, then stop.

    The query's checkpoint remembers the files already taken.  Each micro-batch goes to a folder named by its
    number and overwrites it, so a batch repeated after a failure leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        ensure_checkpoint_dir(batch.sparkSession)
        flagged = clean(batch, kind, within=within)
        flagged.write.mode("overwrite").parquet(f"{target}/{kind}/batch={batch_id}")

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def ingested(spark: SparkSession, target: str, kind: str, valid: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{target}/{kind}").drop("batch")
    if valid:
        return df.filter("_is_valid").select(*[c for c in df.columns if not c.startswith("_")])
    return df.filter(~F.col("_is_valid"))
