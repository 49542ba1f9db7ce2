"""Source codes behind resolved concept sets, and their old/new difference.

``source_concepts``: resolved standard concepts -> source codes through
``Mapped from`` edges (id_1 = standard, id_2 = source).  Not distinct: a
code reached from two concepts of one set appears twice, as in the
reference; the difference below works on sets.

``source_concept_diff``: codes that a concept set covers only in the old
version (``Removed``) or only in the new one (``Added``).  The one-pass
form tags both sides, groups once on ``keys + source_concept_id`` and keeps
groups seen on exactly one side: one shuffle instead of two ``EXCEPT`` plans.
Grouping treats NULL keys as equal, exactly like the set difference.  A concept
that a large share of all codes map to makes a skewed join partition; AQE splits
it, and the rows are dealt by the group before a hash table holds them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MAPPED_FROM, SET_KEYS, Vocabulary

REMOVED = "Removed"
ADDED = "Added"


def source_concepts(
    resolved: DataFrame,
    vocab: Vocabulary,
    keys: Sequence[str] = SET_KEYS,
    valid_only: bool = True,
) -> DataFrame:
    """``keys + source_concept_id`` for each resolved concept and source edge."""
    edges = vocab.edges(MAPPED_FROM, valid_only)
    return resolved.join(edges, F.col("descendant_concept_id") == F.col("concept_id_1")).select(
        *keys, F.col("concept_id_2").alias("source_concept_id")
    )


def source_concept_diff(
    old_sources: DataFrame,
    new_sources: DataFrame,
    keys: Sequence[str] = SET_KEYS,
) -> DataFrame:
    """Removed / Added source codes per concept set (one pass)."""
    cols = [*keys, "source_concept_id"]
    tagged = old_sources.select(*cols, F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(
        new_sources.select(*cols, F.lit(0).alias("_old"), F.lit(1).alias("_new"))
    )
    return (
        tagged.repartition(*cols)
        .groupBy(*cols)
        .agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
        .where(F.col("_old") != F.col("_new"))
        .select(*cols, F.when(F.col("_old") == 1, REMOVED).otherwise(ADDED).alias("action"))
    )


def removed_sources(old_sources: DataFrame, new_sources: DataFrame, keys: Sequence[str] = SET_KEYS) -> DataFrame:
    """``old EXCEPT new``, tagged ``Removed``."""
    cols = [*keys, "source_concept_id"]
    return old_sources.select(*cols).subtract(new_sources.select(*cols)).withColumn("action", F.lit(REMOVED))


def added_sources(old_sources: DataFrame, new_sources: DataFrame, keys: Sequence[str] = SET_KEYS) -> DataFrame:
    """``new EXCEPT old``, tagged ``Added``."""
    cols = [*keys, "source_concept_id"]
    return new_sources.select(*cols).subtract(old_sources.select(*cols)).withColumn("action", F.lit(ADDED))


def source_concept_diff_two_pass(
    old_sources: DataFrame, new_sources: DataFrame, keys: Sequence[str] = SET_KEYS
) -> DataFrame:
    """The literal form: ``(old EXCEPT new) UNION ALL (new EXCEPT old)``."""
    return removed_sources(old_sources, new_sources, keys).unionByName(
        added_sources(old_sources, new_sources, keys)
    )
