"""Run ledger, lineage and schema history as append-only tables; incremental skipping."""

import datetime as dt
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import schema_hash
from ..sources.readers import read_optional

log = logging.getLogger(__name__)

RUN_SCHEMA = ("run_id string, city string, stage string, source_file string, source_hash string, event_at timestamp, "
              "status string, rows_input long, rows_output long, rows_rejected long, error_message string")
LINEAGE_SCHEMA = ("lineage_id string, run_id string, output_table string, source_files string, transformations string, "
                  "created_at timestamp")
HISTORY_SCHEMA = ("schema_id string, run_id string, object_name string, source_file string, schema_hash string, "
                  "columns_json string, captured_at timestamp")
ERROR_LENGTH = 4000


# ---- content hashes -----------------------------------------------------------------------------
def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, file_hash) per file, from its content alone, one rule for all sizes.

    A file is read as rows (lines; bytes between line feeds for other files) and its hash combines their number and the sums
    of two digest parts, so no value ever holds a file and a large one is read by many tasks.  The order of the rows does
    not count.  A file without rows is hashed as such.
    """
    def scan(kind: str) -> DataFrame:
        return spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    name = F.col("_metadata.file_path").alias("_file")
    digest = F.md5("value")
    parts = [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)").alias(f"_d{at}") for at in (1, 16)]
    sums = (scan("text").select(name, *parts).groupBy("_file")
            .agg(F.concat_ws("|", F.count(F.lit(1)), *[F.sum(f"_d{at}") for at in (1, 16)]).alias("_content")))
    listed = scan("binaryFile").select(name, "path", "length")  # the content column is not read
    return listed.join(sums, "_file", "left").select("path", "length", F.md5(F.coalesce("_content", F.lit(""))).alias("file_hash"))


def composite_hash(files: DataFrame, group: list[str] = []) -> DataFrame:
    """One hash per stage from the hashes of its files, whatever their order.

    Files are hashed in up to 4,096 buckets first, so no task gathers all files of a large stage.
    """
    def digest(parts):
        return F.md5(F.array_join(F.array_sort(F.collect_list(parts)), ""))
    bucket = F.substring(F.md5("path"), 1, 3).alias("_bucket")
    buckets = files.groupBy(*group, bucket).agg(digest(F.concat("path", "file_hash")).alias("_h"), F.count("path").alias("_n"))
    return buckets.groupBy(*group).agg(digest(F.concat("_bucket", "_h")).alias("source_hash"), F.sum("_n").alias("files"))


# ---- runs ---------------------------------------------------------------------------------------
def latest_state(events: DataFrame) -> DataFrame:
    """One row per run: first and last event time and the values of the last event."""
    order = F.struct("event_at", F.col("status") != "RUNNING")
    return events.groupBy("run_id").agg(
        F.min("event_at").alias("started_at"),
        F.max(F.when(F.col("status") != "RUNNING", F.col("event_at"))).alias("completed_at"),
        *[F.max_by(c, order).alias(c) for c in ("city", "stage", "source_file", "source_hash", "status", "rows_input",
                                                "rows_output", "rows_rejected", "error_message")])


def recent_runs(events: DataFrame, city: str | None = None, stage: str | None = None, limit: int = 20) -> DataFrame:
    out = events
    if city:
        out = out.filter(F.col("city") == city)
    if stage:
        out = out.filter(F.col("stage") == stage)
    return latest_state(out).orderBy(F.desc("started_at"), "run_id").limit(limit)


def unprocessed(manifest: DataFrame, events: DataFrame) -> DataFrame:
    """Manifest rows (city, stage, source_file, source_hash) without a successful run of the same content."""
    done = latest_state(events).filter("status = 'SUCCESS'").select("city", "stage", "source_file", "source_hash")
    return manifest.join(done, ["city", "stage", "source_file", "source_hash"], "left_anti")


def lineage_of(records: DataFrame, output_table: str | None = None) -> DataFrame:
    out = records.filter(F.col("output_table") == output_table) if output_table else records
    return out.orderBy(F.desc("created_at"), "lineage_id")


def schema_drift(history: DataFrame) -> DataFrame:
    """Each snapshot against the one before it: changed or not, columns added and removed."""
    w = Window.partitionBy("object_name").orderBy("captured_at", "schema_id")
    cols = F.from_json("columns_json", "array<string>")
    seen = history.withColumn("_cols", cols).withColumn("_prev", F.lag("_cols").over(w)).withColumn(
        "_prev_hash", F.lag("schema_hash").over(w))
    return seen.select("object_name", "captured_at", "schema_hash",
                       F.coalesce(F.col("_prev_hash") != F.col("schema_hash"), F.lit(False)).alias("changed"),
                       F.array_join(F.array_sort(F.array_except("_cols", "_prev")), ",").alias("added"),
                       F.array_join(F.array_sort(F.array_except("_prev", "_cols")), ",").alias("removed"))


class Ledger:
    """Ledger tables below one folder; every change is an appended event, nothing is updated in place."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _append(self, table: str, schema: str, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{table}")

    def _read(self, table: str, schema: str) -> DataFrame:
        return read_optional(self.spark, f"{self.folder}/{table}", schema)

    @property
    def events(self) -> DataFrame:
        return self._read("pipeline_runs", RUN_SCHEMA)

    def start(self, city: str, stage: str, source_file: str | None = None, source_hash: str | None = None) -> str:
        run_id = str(uuid.uuid4())
        self._append("pipeline_runs", RUN_SCHEMA, (run_id, city, stage, source_file, source_hash, _now(), "RUNNING",
                                                   None, None, None, None))
        return run_id

    def _close(self, run_id: str, status: str, counts=(None, None, None), error: str | None = None) -> None:
        opened = self.events.filter((F.col("run_id") == run_id) & (F.col("status") == "RUNNING")).first()
        self._append("pipeline_runs", RUN_SCHEMA, (run_id, opened.city, opened.stage, opened.source_file,
                                                   opened.source_hash, _now(), status, *counts, error))

    def complete(self, run_id: str, rows_in: int | None = None, rows_out: int | None = None,
                 rows_rejected: int | None = None) -> None:
        self._close(run_id, "SUCCESS", (rows_in, rows_out, rows_rejected))

    def fail(self, run_id: str, error: str) -> None:
        self._close(run_id, "FAILED", error=error[:ERROR_LENGTH])

    def already_processed(self, source_file: str, source_hash: str | None = None, stage: str | None = None,
                          city: str | None = None) -> bool:
        want = latest_state(self.events).filter("status = 'SUCCESS'").filter(F.col("source_file") == source_file)
        for c, v in (("source_hash", source_hash), ("stage", stage), ("city", city)):
            if v is not None:
                want = want.filter(F.col(c) == v)
        return not want.isEmpty()

    def record_lineage(self, run_id: str, output_table: str, sources: list[str], transforms: list[str]) -> str:
        ident = str(uuid.uuid4())
        self._append("data_lineage", LINEAGE_SCHEMA, (ident, run_id, output_table, ",".join(sources), ",".join(transforms), _now()))
        return ident

    def lineage(self, output_table: str | None = None) -> DataFrame:
        return lineage_of(self._read("data_lineage", LINEAGE_SCHEMA), output_table)

    def record_schema(self, object_name: str, columns: list[str], run_id: str | None = None,
                      source_file: str | None = None) -> str:
        import json
        ident = str(uuid.uuid4())
        self._append("schema_history", HISTORY_SCHEMA, (ident, run_id, object_name, source_file, schema_hash(columns),
                                                        json.dumps(columns), _now()))
        return ident

    @property
    def history(self) -> DataFrame:
        return self._read("schema_history", HISTORY_SCHEMA)

    def recent(self, city: str | None = None, stage: str | None = None, limit: int = 20) -> DataFrame:
        return recent_runs(self.events, city, stage, limit)


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def run_stages(ledger: Ledger, city: str, stages: list[tuple], skip_done: bool = True) -> list[dict]:
    """Runs ``(stage, source file, source hash, action)`` in order; the first failure ends the city.

    An action returns ``(rows in, rows out, rows rejected)``.  Other cities are not affected.
    """
    results = []
    for stage, source, digest, action in stages:
        if skip_done and source and ledger.already_processed(source, digest, stage, city):
            results.append({"city": city, "stage": stage, "status": "SKIPPED"})
            continue
        run_id = ledger.start(city, stage, source, digest)
        try:
            counts = action()
        except Exception as err:
            ledger.fail(run_id, str(err))
            log.exception("stage %s of %s failed", stage, city)
            results.append({"city": city, "stage": stage, "status": "FAILED"})
            break
        ledger.complete(run_id, *counts)
        results.append({"city": city, "stage": stage, "status": "SUCCESS"})
    return results
