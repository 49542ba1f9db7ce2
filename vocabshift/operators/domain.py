"""Domain change: included standard concepts whose domain differs between versions.

Only concepts resolved by a concept set in **both** versions are compared
(``INTERSECT``, distinct).  Each is reported with every valid source code
that maps to it in the new version (codes filtered by source vocabulary),
and the code's record count (0 when absent).

Plan: the concept pairs whose domain changed are found first with one join
of the two concept tables (a small result: only changed concepts), so the
possibly large resolved sets meet a small table that AQE can broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_in
from ..model import MAPPED_FROM, SET_KEYS, Vocabulary


def common_concepts(old_resolved: DataFrame, new_resolved: DataFrame) -> DataFrame:
    """``old INTERSECT new`` (distinct, NULL-safe)."""
    return old_resolved.intersect(new_resolved.select(*old_resolved.columns))


def changed_domains(old: Vocabulary, new: Vocabulary) -> DataFrame:
    """Concepts present in both versions whose domain differs (NULL domains drop out)."""
    co = old.concept.select(F.col("concept_id").alias("_co_id"), F.col("domain_id").alias("old_domain_id"))
    cn = new.concept.select(
        F.col("concept_id").alias("_cn_id"),
        "concept_name",
        "vocabulary_id",
        F.col("domain_id").alias("new_domain_id"),
    )
    return co.join(cn, F.col("_co_id") == F.col("_cn_id")).where(
        F.col("old_domain_id") != F.col("new_domain_id")
    ).select(F.col("_cn_id").alias("concept_id"), "concept_name", "vocabulary_id", "old_domain_id", "new_domain_id")


def domain_change(
    common: DataFrame,
    old: Vocabulary,
    new: Vocabulary,
    counts: DataFrame,
    keys: Sequence[str] = SET_KEYS,
    included_source_vocabs: Iterable[str] | None = None,
    sort: bool = True,
) -> DataFrame:
    """The domain change report (largest source record count first)."""
    changed = changed_domains(old, new)
    edges = new.edges(MAPPED_FROM).select(F.col("concept_id_1").alias("_std"), F.col("concept_id_2").alias("_src"))
    cs = new.concept.where(is_in(F.col("vocabulary_id"), included_source_vocabs)).select(
        F.col("concept_id").alias("_cs_id"),
        F.col("concept_code").alias("source_concept_code"),
        F.col("concept_name").alias("source_concept_name"),
        F.col("vocabulary_id").alias("source_vocabulary_id"),
    )
    cnt = counts.select(F.col("concept_id").alias("_cnt_id"), "record_count")
    out = (
        common.join(changed, F.col("descendant_concept_id") == F.col("concept_id"))
        .join(edges, F.col("concept_id") == F.col("_std"))
        .join(cs, F.col("_src") == F.col("_cs_id"))
        .join(cnt, F.col("_cs_id") == F.col("_cnt_id"), "left")
        .select(
            *keys,
            "concept_id",
            "concept_name",
            "vocabulary_id",
            "source_concept_code",
            "source_concept_name",
            "source_vocabulary_id",
            "old_domain_id",
            "new_domain_id",
            F.coalesce(F.col("record_count"), F.lit(0).cast("bigint")).alias("source_concept_record_count"),
        )
    )
    return out.orderBy(*report_order(keys)) if sort else out


def report_order(keys: Sequence[str] = SET_KEYS) -> list:
    """Largest source record count first; the other columns split ties."""
    ties = ("concept_id", "source_vocabulary_id", "source_concept_code", "source_concept_name")
    return [F.col("source_concept_record_count").desc(), *keys, *ties]
