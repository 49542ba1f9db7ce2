"""Readers for the analysis inputs held as tables.

Every reader takes a *location*: a folder of tables (``/data/vocab/v1``), read
in the given format, or a schema of catalog tables (``fmt="table"``, location
``vocab_v1`` reads ``vocab_v1.concept`` by ``spark.table``).  Formats: Parquet,
ORC and other self-describing ones; ``csv`` and ``tsv`` with a header row (the
form that vocabulary releases come in).  Columns are picked by name without
regard to case and cast to the contract types, so text columns of delimited
files become ids and counts here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ANCESTOR_SCHEMA, CONCEPT_SCHEMA, COUNT_SCHEMA, RELATIONSHIP_SCHEMA, Vocabulary
from ..operators.stats import EVENT_SOURCE_COLUMNS

COHORT_MAP_SCHEMA = T.StructType(
    [
        T.StructField("old_cohort_id", T.LongType()),
        T.StructField("new_cohort_id", T.LongType()),
        T.StructField("old_cohort_vocab_version", T.StringType()),
    ]
)
COHORT_NAME_SCHEMA = T.StructType([T.StructField("cohortid", T.LongType()), T.StructField("cohortname", T.StringType())])
SEPARATORS = {"csv": ",", "tsv": "\t"}


def _read(spark: SparkSession, location: str, name: str, fmt: str) -> DataFrame:
    """One table of a location; an empty ``name`` means the location itself."""
    if fmt == "table":
        return spark.table(f"{location}.{name}" if name else location)
    path = f"{location.rstrip('/')}/{name}" if name else location
    if fmt in SEPARATORS:
        # vocabulary releases are unquoted: a quote in a concept name is text
        reader = spark.read.option("header", True).option("sep", SEPARATORS[fmt])
        return (reader.option("quote", "") if fmt == "tsv" else reader).csv(path)
    return spark.read.format(fmt).load(path)


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the contract columns (case-insensitive) with their contract types."""
    lower = {c.lower(): c for c in df.columns}
    missing = [f.name for f in schema.fields if f.name not in lower]
    if missing:
        raise ValueError(f"the table lacks columns {missing}; it has {df.columns}")
    return df.select(*[F.col(f"`{lower[f.name]}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def read_vocabulary(spark: SparkSession, location: str, fmt: str = "parquet") -> Vocabulary:
    """The tables ``concept``, ``concept_ancestor`` and ``concept_relationship`` of one version."""
    return Vocabulary(
        _conform(_read(spark, location, "concept", fmt), CONCEPT_SCHEMA),
        _conform(_read(spark, location, "concept_ancestor", fmt), ANCESTOR_SCHEMA),
        _conform(_read(spark, location, "concept_relationship", fmt), RELATIONSHIP_SCHEMA),
    )


def read_counts(spark: SparkSession, location: str, fmt: str = "parquet", name: str = "") -> DataFrame:
    """The record-count table: ``concept_id, record_count, descendant_record_count``."""
    return _conform(_read(spark, location, name, fmt), COUNT_SCHEMA)


def read_events(spark: SparkSession, location: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The six clinical event tables, pruned to person and source concept."""
    out = {}
    for name, column in EVENT_SOURCE_COLUMNS.items():
        schema = T.StructType([T.StructField("person_id", T.LongType()), T.StructField(column, T.LongType())])
        out[name] = _conform(_read(spark, location, name, fmt), schema)
    return out


def read_cohort_map(
    spark: SparkSession, location: str, version: str | None = None, fmt: str = "csv", name: str = ""
) -> DataFrame:
    """The old/new cohort pair table (CSV, any other format or a catalog table), optionally one vocabulary version only."""
    df = _conform(_read(spark, location, name, fmt), COHORT_MAP_SCHEMA)
    if version is not None:
        df = df.where(F.col("old_cohort_vocab_version") == version)
    return df


def read_cohort_names(spark: SparkSession, location: str, fmt: str = "csv") -> DataFrame:
    """``cohortid, cohortname`` table."""
    return _conform(_read(spark, location, "", fmt), COHORT_NAME_SCHEMA)
