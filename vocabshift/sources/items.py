"""Concept-set items from cohort-definition documents.

A cohort definition is a JSON document ``{id, name, createdDate,
expression: {ConceptSets: [{id, name, expression: {items: [{concept:
{CONCEPT_ID}, isExcluded, includeDescendants}]}}]}}``.  Flattening is two
``explode``s over a declared schema (no inference): a cohort without
concept sets and a set without items yield no rows, and a document that
does not parse yields no rows either (PERMISSIVE read, corrupt text kept
in ``_corrupt_record``).  Missing flags read as false.

The library form holds one JSON text ``{items: [...]}`` per concept set in
a string column next to the cohort and set ids; it is parsed with
``from_json`` and joined to the cohort log for names and dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM_STRUCT = T.StructType(
    [
        T.StructField("concept", T.StructType([T.StructField("CONCEPT_ID", T.LongType())])),
        T.StructField("isExcluded", T.BooleanType()),
        T.StructField("includeDescendants", T.BooleanType()),
    ]
)
CONCEPT_SET_EXPRESSION = T.StructType([T.StructField("items", T.ArrayType(ITEM_STRUCT))])
CONCEPT_SET_STRUCT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("expression", CONCEPT_SET_EXPRESSION),
    ]
)
COHORT_DEFINITION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("createdDate", T.StringType()),
        T.StructField(
            "expression",
            T.StructType([T.StructField("ConceptSets", T.ArrayType(CONCEPT_SET_STRUCT))]),
        ),
    ]
)
CORRUPT = "_corrupt_record"


def _item_columns(item: str) -> list:
    return [
        F.col(f"{item}.concept.CONCEPT_ID").alias("conceptid"),
        F.coalesce(F.col(f"{item}.isExcluded"), F.lit(False)).cast("int").alias("isexcluded"),
        F.coalesce(F.col(f"{item}.includeDescendants"), F.lit(False)).cast("int").alias("includedescendants"),
    ]


def read_cohort_definitions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Read exported cohort-definition JSON documents with the declared schema."""
    schema = T.StructType(COHORT_DEFINITION_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(schema)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def parse_cohort_definitions(df: DataFrame, json_col: str = "definition") -> DataFrame:
    """Parse a string column of definition documents into the definition struct columns."""
    parsed = F.from_json(F.col(json_col), COHORT_DEFINITION_SCHEMA)
    return df.select(parsed.alias("_d")).select("_d.*")


def concept_set_items(definitions: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Flatten definitions to one row per concept-set item.

    ``requested`` (column ``cohortid``) keeps the cohorts it names.

    Columns: conceptid, isexcluded, includedescendants, conceptsetid,
    conceptsetname, cohortid, cohortname, createddate.
    """
    d = definitions
    if CORRUPT in d.columns:
        d = d.where(F.col(CORRUPT).isNull())
    if requested is not None:
        d = d.join(requested.select(F.col("cohortid").alias("_wanted")), F.col("id") == F.col("_wanted"), "left_semi")
    sets = d.select(
        F.col("id").alias("cohortid"),
        F.col("name").alias("cohortname"),
        F.col("createdDate").alias("createddate"),
        F.explode("expression.ConceptSets").alias("_set"),
    )
    items = sets.select(
        "cohortid",
        "cohortname",
        "createddate",
        F.col("_set.id").alias("conceptsetid"),
        F.col("_set.name").alias("conceptsetname"),
        F.explode("_set.expression.items").alias("_item"),
    )
    return items.select(
        *_item_columns("_item"),
        "conceptsetid",
        "conceptsetname",
        "cohortid",
        "cohortname",
        "createddate",
    )


def missing_cohorts(requested: DataFrame, definitions: DataFrame) -> DataFrame:
    """Requested cohort ids (column ``cohortid``) with no parsable definition."""
    found = definitions
    if CORRUPT in found.columns:
        found = found.where(F.col(CORRUPT).isNull())
    return requested.join(found.select(F.col("id").alias("cohortid")), "cohortid", "left_anti")


def concept_set_items_from_json(
    library: DataFrame,
    json_col: str = "conceptSetExpression",
    cohort_col: str = "cohortId",
    set_id_col: str = "conceptSetId",
    set_name_col: str = "conceptSetName",
) -> DataFrame:
    """Items from one ``{items: [...]}`` JSON text per concept set."""
    parsed = library.select(
        F.col(cohort_col).cast("bigint").alias("cohortid"),
        F.col(set_id_col).cast("bigint").alias("conceptsetid"),
        F.col(set_name_col).alias("conceptsetname"),
        F.explode(F.from_json(F.col(json_col), CONCEPT_SET_EXPRESSION)["items"]).alias("_item"),
    )
    return parsed.select(*_item_columns("_item"), "conceptsetid", "conceptsetname", "cohortid")


def library_items(library: DataFrame, log: DataFrame, **cols) -> DataFrame:
    """Library items joined (inner) to the cohort log for name and creation date."""
    items = concept_set_items_from_json(library, **cols)
    names = log.select(
        F.col("cohortId").cast("bigint").alias("_log_id"),
        F.col("cohortName").alias("cohortname"),
        F.col("createdDate").alias("createddate"),
    )
    return items.join(names, F.col("cohortid") == F.col("_log_id")).drop("_log_id")
