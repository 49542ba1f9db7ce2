"""Small hand-written tables for unit tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vocabshift.model import Vocabulary

ITEMS = (
    "conceptid bigint, isexcluded int, includedescendants int, conceptsetid bigint, "
    "conceptsetname string, cohortid bigint, cohortname string"
)
CONCEPT = (
    "concept_id bigint, concept_name string, domain_id string, vocabulary_id string, "
    "standard_concept string, concept_code string"
)
ANCESTOR = "ancestor_concept_id bigint, descendant_concept_id bigint"
RELATIONSHIP = "concept_id_1 bigint, concept_id_2 bigint, relationship_id string, invalid_reason string"
COUNTS = "concept_id bigint, record_count bigint, descendant_record_count bigint"


def df(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def vocab(spark: SparkSession, concepts, ancestors=(), relationships=()) -> Vocabulary:
    return Vocabulary(
        df(spark, list(concepts), CONCEPT),
        df(spark, list(ancestors), ANCESTOR),
        df(spark, list(relationships), RELATIONSHIP),
    )


def maps(source: int, target: int, invalid: str | None = None):
    """Both directions of one mapping edge."""
    return [(source, target, "Maps to", invalid), (target, source, "Mapped from", invalid)]


def rows(frame: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=repr)
