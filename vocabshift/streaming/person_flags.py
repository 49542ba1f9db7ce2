"""Incremental person flags over event files that keep arriving.

Clinical event tables grow; the person-level part of the stats (which
cohort's persons have same / added / removed codes) can be kept current
without rescanning history.  The flags are MAX aggregates, which are
idempotent and monotone, so each micro-batch only needs the partial flags
of its own events: they are appended to a flag log, and the current flags
are the MAX over the log.

The concept diff is written once per vocabulary version, under the log, and
every micro-batch reads that table: nothing of the diff is computed again.
The log has a folder per version, so a new release never meets old flags.
Each batch writes its own folder with overwrite, so a batch replayed after a
failure replaces its earlier attempt (exactly-once result on top of the
at-least-once ``foreachBatch``).  ``compact_flags`` folds the batches of a
version into one; ``max_files_per_trigger`` bounds a batch.  Progress is kept
in the streaming checkpoint, which must live in shared storage on a cluster.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import stats as S
from ..plans.broadcast import rows_fit

DIFF_SCHEMA = "cohort_definition_id bigint, concept_id bigint, concept_type string"
FLAG_LOG_SCHEMA = "cohort_definition_id bigint, person_id bigint, has_same int, has_new int, has_old int"


def read_event_streams(
    spark: SparkSession,
    paths: Mapping[str, str],
    columns: Mapping[str, str] = S.EVENT_SOURCE_COLUMNS,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Union of the event tables as one stream of ``(person_id, source_concept_id)``."""

    def stream(name: str, path: str) -> DataFrame:
        reader = spark.readStream.schema(f"person_id bigint, {columns[name]} bigint")
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.parquet(path)

    return S.union_events({name: stream(name, path) for name, path in paths.items()}, columns)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _version_log(log_path: str, version: str) -> str:
    return f"{log_path.rstrip('/')}/version={version}"


def start_person_flags(
    events: DataFrame,
    diff: DataFrame,
    log_path: str,
    checkpoint_location: str,
    version: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream: each micro-batch adds its partial flags to the log of ``version``.

    ``diff`` is written on the first start of a version and read from there after.
    """
    spark = events.sparkSession
    log = _version_log(log_path, version)
    if not _exists(spark, f"{log}/diff/_SUCCESS"):
        diff.write.mode("overwrite").parquet(f"{log}/diff")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        known = batch.sparkSession.read.schema(DIFF_SCHEMA).parquet(f"{log}/diff")
        flags = S.person_flags(batch, known, rows_fit(known, S.WORD_ROW_BYTES))
        flags.write.mode("overwrite").parquet(f"{log}/flags/batch_id={batch_id}")

    writer = events.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{checkpoint_location}/{version}")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def current_flags(spark: SparkSession, log_path: str, version: str) -> DataFrame:
    """Person flags of a version over everything processed so far (MAX over its flag log)."""
    log = spark.read.schema(FLAG_LOG_SCHEMA).parquet(f"{_version_log(log_path, version)}/flags")
    return log.groupBy("cohort_definition_id", "person_id").agg(
        F.max("has_same").alias("has_same"), F.max("has_new").alias("has_new"), F.max("has_old").alias("has_old")
    )


def compact_flags(spark: SparkSession, log_path: str, version: str, next_batch: int) -> None:
    """Fold the batches below ``next_batch`` into one (numbered ``next_batch - 1``); run it between two streams.

    The folded flags are complete before the old folders go; flags are maxima, so a run that stops in between
    leaves rows that count twice without changing any flag.
    """
    flags = f"{_version_log(log_path, version)}/flags"
    folded = f"{_version_log(log_path, version)}/folded-{next_batch}"
    current_flags(spark, log_path, version).write.mode("overwrite").parquet(folded)
    spark.read.schema(FLAG_LOG_SCHEMA).parquet(folded).write.mode("overwrite").parquet(f"{flags}/batch_id={next_batch - 1}")
    root = spark._jvm.org.apache.hadoop.fs.Path(flags)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("batch_id=") and int(name.partition("=")[2]) < next_batch - 1:
            fs.delete(status.getPath(), True)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folded), True)
