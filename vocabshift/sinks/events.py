"""An event layout that spares repeated analyses the shuffle of the events.

Every new vocabulary release is compared over the same events.  The layout holds what the stats read of them - the distinct
(person, source code) pairs of all event tables - bucketed by person and sorted by code.  Person flags are grouped by person,
so a bucketed scan needs no exchange of events: neither for distinct pairs nor for flags.  Many events of one person and
code are one pair, so no bucket grows with a hot code.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.stats import union_events


def write_event_layout(
    events: Mapping[str, DataFrame] | DataFrame, table: str, buckets: int, path: str | None = None, mode: str = "errorifexists"
) -> DataFrame:
    """Write the pairs of ``events`` as the catalog table ``table`` with ``buckets`` buckets (at ``path``, else in the warehouse)."""
    union = events if isinstance(events, DataFrame) else union_events(events)
    pairs = union.select("person_id", "source_concept_id").where("source_concept_id is not null").distinct()
    writer = pairs.repartition(buckets, "person_id").write.mode(mode).bucketBy(buckets, "person_id").sortBy("source_concept_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return read_event_layout(union.sparkSession, table)


def read_event_layout(spark: SparkSession, table: str) -> DataFrame:
    """``(person_id, source_concept_id)`` of a layout, to be given as ``events``."""
    return spark.table(table).select("person_id", "source_concept_id")
