"""Cohort-definition documents built from item rows (test inputs for the JSON sources).

This is fixture code: it writes documents so that the readers have something to read.  A cohort is cut into
documents by concept-id range, so that no aggregation group grows with the cohort; the parts carry the cohort's id,
name and date, and flattening them gives back exactly the item rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDS_PER_DOCUMENT = 1000


def _item_struct():
    return F.struct(
        F.struct(F.col("conceptid").alias("CONCEPT_ID")).alias("concept"),
        (F.col("isexcluded") == 1).alias("isExcluded"),
        (F.col("includedescendants") == 1).alias("includeDescendants"),
    )


def _part(ids_per_document: int):
    """Document part of an item: its concept-id range (bounds the items gathered per document)."""
    return F.floor(F.col("conceptid") / F.lit(ids_per_document)).alias("_part")


def to_cohort_definitions(items: DataFrame, ids_per_document: int = IDS_PER_DOCUMENT) -> DataFrame:
    """Nest item rows into cohort-definition documents (JSON text).

    A cohort is cut into parts by concept-id range, so no document (and no
    aggregation group) holds more than ``ids_per_document`` distinct concept
    ids per set, whatever the size of the cohort; every part carries the
    cohort's id, name and date, and flattening the parts gives back exactly
    the item rows.
    """
    cohort_keys = ["cohortid", "cohortname"] + (["createddate"] if "createddate" in items.columns else [])
    created = F.col("createddate") if "createddate" in items.columns else F.lit(None).cast("string")
    concept_set = F.struct(
        F.col("conceptsetid").alias("id"),
        F.col("conceptsetname").alias("name"),
        F.struct(F.col("items").alias("items")).alias("expression"),
    )
    sets = items.groupBy(*cohort_keys, _part(ids_per_document), "conceptsetid", "conceptsetname").agg(
        F.collect_list(_item_struct()).alias("items")
    )
    docs = sets.groupBy(*cohort_keys, "_part").agg(F.collect_list(concept_set).alias("ConceptSets"))
    return docs.select(
        F.to_json(
            F.struct(
                F.col("cohortid").alias("id"),
                F.col("cohortname").alias("name"),
                created.alias("createdDate"),
                F.struct(F.col("ConceptSets").alias("ConceptSets")).alias("expression"),
            )
        ).alias("definition")
    )


def to_library_concept_sets(items: DataFrame, ids_per_document: int = IDS_PER_DOCUMENT) -> DataFrame:
    """``{items: [...]}`` JSON texts per (cohort, concept set, concept-id range)."""
    return items.groupBy(
        F.col("cohortid").alias("cohortId"),
        F.col("conceptsetid").alias("conceptSetId"),
        F.col("conceptsetname").alias("conceptSetName"),
        _part(ids_per_document),
    ).agg(F.to_json(F.struct(F.collect_list(_item_struct()).alias("items"))).alias("conceptSetExpression")).drop(
        "_part"
    )
