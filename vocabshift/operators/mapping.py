"""Old and new mappings of added/removed source codes, and their comparison.

``mapping_old``: each differing code with its details from the **new**
concept table (a code missing there is dropped), its record count (codes
without a count row are dropped), and its ``Maps to`` targets in the **old**
version (LEFT: an unmapped code keeps one row with NULL target).
``mapping_new``: the same codes with their ``Maps to`` targets in the new
version.  ``aggregate_mapping`` folds the targets of one code into
``'-'``-joined, id-ordered text lists, and ``mapping_diff`` puts the old and
new lists side by side (NULL-safe join on the code's keys).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregate import join_field, ordered_join_columns, sorted_struct_list
from ..functions.columns import is_in
from ..model import MAPS_TO, SET_KEYS, Vocabulary

TARGET_COLUMNS = ("concept_id", "concept_name", "vocabulary_id", "concept_code")
SOURCE_DETAIL_COLUMNS = ("source_concept_name", "source_vocabulary_id", "source_concept_code")


def with_targets(df: DataFrame, vocab: Vocabulary, valid_only: bool = True) -> DataFrame:
    """Append ``Maps to`` targets of ``source_concept_id`` (LEFT, LEFT).

    The target columns come from the concept table, so a target id absent
    there shows as NULL, like the reference's second LEFT JOIN.
    """
    edges = vocab.edges(MAPS_TO, valid_only).select(
        F.col("concept_id_1").alias("_src"), F.col("concept_id_2").alias("_tgt")
    )
    targets = vocab.concept.select(*TARGET_COLUMNS)
    return (
        df.join(edges, F.col("source_concept_id") == F.col("_src"), "left")
        .join(targets, F.col("_tgt") == F.col("concept_id"), "left")
        .drop("_src", "_tgt")
    )


def source_details(
    dif: DataFrame,
    new: Vocabulary,
    counts: DataFrame,
    keys: Sequence[str] = SET_KEYS,
    included_source_vocabs: Iterable[str] | None = None,
) -> DataFrame:
    """Differing codes with their details from the new concept table and their record count."""
    cs = new.concept.where(is_in(F.col("vocabulary_id"), included_source_vocabs)).select(
        F.col("concept_id").alias("_cs_id"),
        F.col("concept_name").alias("source_concept_name"),
        F.col("vocabulary_id").alias("source_vocabulary_id"),
        F.col("concept_code").alias("source_concept_code"),
    )
    cnt = counts.select(F.col("concept_id").alias("_cnt_id"), "record_count")
    return (
        dif.join(cs, F.col("source_concept_id") == F.col("_cs_id"))
        .join(cnt, F.col("_cs_id") == F.col("_cnt_id"))
        .select(*keys, "action", "record_count", "source_concept_id", *SOURCE_DETAIL_COLUMNS)
    )


def mapping_old(
    dif: DataFrame,
    old: Vocabulary,
    new: Vocabulary,
    counts: DataFrame,
    keys: Sequence[str] = SET_KEYS,
    included_source_vocabs: Iterable[str] | None = None,
) -> DataFrame:
    """Differing codes with source details, record count and old targets."""
    return with_targets(source_details(dif, new, counts, keys, included_source_vocabs), old)


def mapping_new(dif: DataFrame, new: Vocabulary) -> DataFrame:
    """Differing codes with their new targets (all codes, no count filter)."""
    return with_targets(dif, new)


def aggregate_mapping(mapping: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """One row per ``keys``: ``<prefix>_mapped_{concept_id, concept_name, ...}`` lists."""
    return mapping.groupBy(*keys).agg(*ordered_join_columns("concept_id", TARGET_COLUMNS, f"{prefix}_mapped_"))


def old_aggregate_keys(keys: Sequence[str] = SET_KEYS) -> list[str]:
    return [*keys, "source_concept_id", "record_count", "action", *SOURCE_DETAIL_COLUMNS]


def new_aggregate_keys(keys: Sequence[str] = SET_KEYS) -> list[str]:
    return [*keys, "source_concept_id", "action"]


def mapping_diff(
    old_agg: DataFrame,
    new_agg: DataFrame,
    keys: Sequence[str] = SET_KEYS,
    changed_only: bool = False,
    sort: bool = True,
) -> DataFrame:
    """Old and new target lists side by side, largest record count first.

    ``changed_only`` keeps codes whose target id list differs (NULL lists
    compare as empty text), as the old/new cohort comparison does.
    """
    join_keys = new_aggregate_keys(keys)
    right = new_agg.select(
        *[F.col(k).alias(f"_r_{k}") for k in join_keys],
        *[c for c in new_agg.columns if c not in join_keys],
    )
    cond = None
    for k in join_keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    out = old_agg.join(right, cond).drop(*[f"_r_{k}" for k in join_keys])
    if changed_only:
        out = out.where(
            F.coalesce(F.col("old_mapped_concept_id"), F.lit(""))
            != F.coalesce(F.col("new_mapped_concept_id"), F.lit(""))
        )
    return out.orderBy(*report_order(keys)) if sort else out


def report_order(keys: Sequence[str] = SET_KEYS) -> list:
    """Largest record count first; set and code split ties."""
    return [F.col("record_count").desc(), *keys, "source_concept_id", "action"]


def target_lists(codes: DataFrame, vocab: Vocabulary, name: str) -> DataFrame:
    """``_code, <name>``: the ordered targets of every code in ``codes`` (column ``_code``).

    The edges are filtered by the codes before they meet the concept table, and gathered once per code, however many
    sets hold it.  A code's array holds its own targets only; a code without a target has no row.
    """
    edges = vocab.edges(MAPS_TO).select(F.col("concept_id_1").alias("_from"), F.col("concept_id_2").alias("_to"))
    edges = edges.join(codes, F.col("_from") == F.col("_code"), "left_semi")
    targets = edges.join(vocab.concept.select(*TARGET_COLUMNS), F.col("_to") == F.col("concept_id"), "left")
    lists = targets.groupBy("_from").agg(sorted_struct_list("concept_id", TARGET_COLUMNS).alias(name))
    return lists.withColumnRenamed("_from", "_code")


def mapping_diff_one_pass(
    dif: DataFrame,
    old: Vocabulary,
    new: Vocabulary,
    counts: DataFrame,
    keys: Sequence[str] = SET_KEYS,
    included_source_vocabs: Iterable[str] | None = None,
    changed_only: bool = False,
    sort: bool = True,
) -> DataFrame:
    """Same rows as ``mapping_diff(aggregate(mapping_old), aggregate(mapping_new))``, lists built once per code.

    The report rows are the differing codes with their details; a row that duplicate count or concept rows repeat
    repeats each of its old targets as often, as the two-sided form does.  Old and new target lists depend on the
    code alone, so they are built per code and joined to the rows.
    """
    group = old_aggregate_keys(keys)
    base = source_details(dif, new, counts, keys, included_source_vocabs).groupBy(*group).agg(F.count("*").alias("_times"))
    codes = dif.select(F.col("source_concept_id").alias("_code")).distinct()
    lists = (
        codes.join(target_lists(codes, old, "_old"), "_code", "left")
        .join(target_lists(codes, new, "_new"), "_code", "left")
        .select("_code", "_old", "_new")
    )
    # no target: one row of NULLs, as of a left join
    missing = F.array(F.struct(F.lit(True).alias("_null"), *[F.lit(None).cast("string").alias(c) for c in TARGET_COLUMNS]))
    text = lambda c: F.transform(
        c, lambda t: F.struct(t["_null"].alias("_null"), *[t[x].cast("string").alias(x) for x in TARGET_COLUMNS])
    )
    repeated = F.flatten(F.transform(F.coalesce(text(F.col("_old")), missing), lambda t: F.array_repeat(t, F.col("_times").cast("int"))))
    shown = F.coalesce(text(F.col("_new")), missing)
    out = base.join(lists, F.col("source_concept_id") == F.col("_code")).select(
        *group,
        *[join_field(repeated, c).alias(f"old_mapped_{c}") for c in TARGET_COLUMNS],
        *[join_field(shown, c).alias(f"new_mapped_{c}") for c in TARGET_COLUMNS],
    )
    if changed_only:
        out = out.where(
            F.coalesce(F.col("old_mapped_concept_id"), F.lit(""))
            != F.coalesce(F.col("new_mapped_concept_id"), F.lit(""))
        )
    return out.orderBy(*report_order(keys)) if sort else out
