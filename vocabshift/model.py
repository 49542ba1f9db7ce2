"""Data model: the vocabulary bundle, column contracts and item normalisation.

Every table is a plain DataFrame.  A vocabulary version is a bundle of
three tables (``concept``, ``concept_ancestor``, ``concept_relationship``);
an analysis compares two such bundles.  Column names are lower snake_case
everywhere; flags are INT 0/1 so that SQL-style comparisons with integers
work under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Relationship types and validity used by the analysis (fixed vocabulary values).
MAPS_TO = "Maps to"
MAPPED_FROM = "Mapped from"
MAPS_TO_VALUE = "Maps to value"

# Concept-set item columns (the input contract).
ITEM_COLUMNS = (
    "conceptid",
    "isexcluded",
    "includedescendants",
    "conceptsetid",
    "conceptsetname",
    "cohortid",
    "cohortname",
)

# Keys that identify one concept set of one cohort.  The main path carries
# the cohort name, the old/new cohort pair path does not.
SET_KEYS = ("cohortid", "cohortname", "conceptsetname", "conceptsetid")
PAIR_SET_KEYS = ("cohortid", "conceptsetname", "conceptsetid")

ITEM_TYPES = {
    "conceptid": T.LongType(),
    "isexcluded": T.IntegerType(),
    "includedescendants": T.IntegerType(),
    "conceptsetid": T.LongType(),
    "conceptsetname": T.StringType(),
    "cohortid": T.LongType(),
    "cohortname": T.StringType(),
    "createddate": T.StringType(),
}

CONCEPT_SCHEMA = T.StructType(
    [
        T.StructField("concept_id", T.LongType()),
        T.StructField("concept_name", T.StringType()),
        T.StructField("domain_id", T.StringType()),
        T.StructField("vocabulary_id", T.StringType()),
        T.StructField("standard_concept", T.StringType()),
        T.StructField("concept_code", T.StringType()),
    ]
)
ANCESTOR_SCHEMA = T.StructType(
    [
        T.StructField("ancestor_concept_id", T.LongType()),
        T.StructField("descendant_concept_id", T.LongType()),
    ]
)
RELATIONSHIP_SCHEMA = T.StructType(
    [
        T.StructField("concept_id_1", T.LongType()),
        T.StructField("concept_id_2", T.LongType()),
        T.StructField("relationship_id", T.StringType()),
        T.StructField("invalid_reason", T.StringType()),
    ]
)
COUNT_SCHEMA = T.StructType(
    [
        T.StructField("concept_id", T.LongType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("descendant_record_count", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Vocabulary:
    """One version of the vocabulary: three DataFrames."""

    concept: DataFrame
    ancestor: DataFrame
    relationship: DataFrame

    def edges(self, relationship_id: str, valid_only: bool = True) -> DataFrame:
        """``(concept_id_1, concept_id_2)`` edges of one type.

        The type and validity predicates sit directly on the scan, so
        Parquet receives them as pushed filters and only two id columns
        are read afterwards.
        """
        cond = F.col("relationship_id") == F.lit(relationship_id)
        if valid_only:
            cond = cond & F.col("invalid_reason").isNull()
        return self.relationship.where(cond).select("concept_id_1", "concept_id_2")


def _flag(c: Column) -> Column:
    """Boolean or numeric flag -> INT 0/1, NULL stays NULL."""
    return c.cast("int")


def normalise_items(items: DataFrame) -> DataFrame:
    """Canonicalise a concept-set item table.

    Accepts any capitalisation of the column names (``ConceptID``,
    ``isExcluded``, ``cohortName`` ...), casts ids to BIGINT and flags to INT
    (``true``/``false`` -> 1/0).  NULL flags are kept: like the SQL they then
    fall out of both the include and the exclude branch.  A missing
    ``cohortname`` column becomes NULL.
    """
    lower = {c.lower(): c for c in items.columns}
    if "cohortdefinitionid" in lower and "cohortid" not in lower:
        lower["cohortid"] = lower["cohortdefinitionid"]
    missing = [c for c in ITEM_COLUMNS if c not in lower and c != "cohortname"]
    if missing:
        raise ValueError(f"concept-set items lack columns {missing}")
    cols = []
    for name in ITEM_COLUMNS + ("createddate",):
        typ = ITEM_TYPES[name]
        if name in lower:
            src = F.col(f"`{lower[name]}`")
            src = _flag(src) if typ == T.IntegerType() else src.cast(typ)
        elif name == "createddate":
            continue
        else:
            src = F.lit(None).cast(typ)
        cols.append(src.alias(name))
    return items.select(*cols)


def source_vocabularies(values: Sequence[str] | None) -> list[str] | None:
    """The source vocabularies of a report; ``None`` means all of them, an empty list or a non-list is an error."""
    if values is None:
        return None
    if isinstance(values, (str, int)) or not list(values):
        raise ValueError("included_source_vocabs must be a non-empty list of vocabulary ids, or None for all of them")
    return list(values)
