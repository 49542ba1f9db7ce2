"""Cohort-level impact statistics: codes and persons that stay, are gained or lost.

Chain: concept pool (source codes of each cohort, old and new) ->
concept diff (same / removed / added per cohort and code) -> per-cohort
code counts; events x concept diff -> person flags -> flag histogram ->
per-cohort person summary -> the stats report.

Stats work per cohort (concept-set ids dropped) and, like the reference,
accept invalid ``Mapped from`` edges by default (``valid_only=False``).

Plan for the event side (the only input that grows to terabytes): the six
event tables are projected to ``(person_id, source_concept_id)`` and unioned.

* Events of codes outside the diff are dropped in the scan stage: by a
  broadcast of the diff's codes while their bytes are bounded, beyond that by a
  filter of bounded size (``code_filter``) whatever the vocabulary's size.
* What is left is reduced to distinct (person, code) pairs, map-side first,
  which collapses hot pairs, before anything is shuffled by code.
* A code's cohorts are bitmaps of ``WORD`` cohorts a row (``cohort_words``), so
  no row grows with the cohorts, and flags of ``WORD`` cohorts are aggregated
  at once per person by OR.  Cohorts are told apart only in the result.
* Above the bound the pairs meet the bitmaps in a join whose output is
  shuffled anew by (person, word), so AQE may split a code that many have.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import bit_at, bits_in, one_bit
from ..functions.columns import count_if, is_in, safe_ratio
from ..model import MAPPED_FROM, Vocabulary
from ..plans.broadcast import broadcast_if

SAME, REMOVED, ADDED = "same", "removed", "added"

# The six clinical event tables and their source-concept columns (fixed names).
EVENT_SOURCE_COLUMNS = {
    "condition_occurrence": "condition_source_concept_id",
    "procedure_occurrence": "procedure_source_concept_id",
    "drug_exposure": "drug_source_concept_id",
    "device_exposure": "device_source_concept_id",
    "measurement": "measurement_source_concept_id",
    "observation": "observation_source_concept_id",
}


def _pool_side(resolved: DataFrame, vocab: Vocabulary, tag: str, vocabs, valid_only: bool) -> DataFrame:
    edges = vocab.edges(MAPPED_FROM, valid_only)
    codes = vocab.concept.where(is_in(F.col("vocabulary_id"), vocabs)).select(F.col("concept_id").alias("_code_id"))
    return (
        resolved.join(edges, F.col("descendant_concept_id") == F.col("concept_id_1"))
        .join(codes, F.col("concept_id_2") == F.col("_code_id"))
        .select(
            F.col("cohortid").alias("cohort_definition_id"),
            F.lit(tag).alias("concept_type"),
            F.col("_code_id").alias("concept_id"),
        )
    )


def concept_pool(
    old_resolved: DataFrame,
    new_resolved: DataFrame,
    old: Vocabulary,
    new: Vocabulary,
    included_source_vocabs: Iterable[str] | None = None,
    valid_only: bool = False,
) -> DataFrame:
    """``(cohort_definition_id, concept_type 'old'|'new', concept_id)``, UNION ALL."""
    return _pool_side(old_resolved, old, "old", included_source_vocabs, valid_only).unionByName(
        _pool_side(new_resolved, new, "new", included_source_vocabs, valid_only)
    )


def concept_diff(pool: DataFrame) -> DataFrame:
    """``(cohort_definition_id, concept_id, concept_type same|removed|added)``."""
    first, last = F.min("concept_type").alias("first"), F.max("concept_type").alias("last")
    sides = pool.groupBy("cohort_definition_id", "concept_id").agg(first, last)  # 'new' < 'old'
    kind = (
        F.when(F.col("first") != F.col("last"), SAME).when(F.col("last") == "old", REMOVED).otherwise(ADDED)
    )
    return sides.select("cohort_definition_id", "concept_id", kind.alias("concept_type"))


def concept_count_change(diff: DataFrame) -> DataFrame:
    """Per cohort: number of same, removed and added codes (BIGINT)."""
    t = F.col("concept_type")
    return diff.groupBy("cohort_definition_id").agg(
        count_if(t == SAME).alias("same_concepts_count"),
        count_if(t == REMOVED).alias("removed_concepts_count"),
        count_if(t == ADDED).alias("added_concepts_count"),
    )


def union_events(tables: Mapping[str, DataFrame], columns: Mapping[str, str] = EVENT_SOURCE_COLUMNS) -> DataFrame:
    """Project each event table to ``(person_id, source_concept_id)`` and union them."""
    parts = [
        df.select("person_id", F.col(columns[name]).alias("source_concept_id")) for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


WORD = 64  # cohorts in one bitmap
FILTER_BLOCKS = 1 << 18  # most rows of a code filter: 40 bytes each, about 10 MB
FILTER_LANES = 4  # 64 bits each
WORD_ROW_BYTES = 64  # a row of cohort_words in memory, with room to spare
CODE_ROW_BYTES = 32


def code_filter(codes: DataFrame, blocks: int = FILTER_BLOCKS) -> DataFrame:
    """A blocked Bloom filter of the ids in ``concept_id``: ``_block`` and ``FILTER_LANES`` words, at most ``blocks`` rows.

    An id sets one bit in each lane of its block.  The bound on the rows holds for any number of ids; with
    ten million in the default size about one other id in twenty passes.
    """
    ids = codes.select(F.col("concept_id").alias("_id")).where("_id is not null").distinct()
    h = F.xxhash64("_id")
    block = F.pmod(h, F.lit(blocks)).alias("_block")
    lanes = [F.bit_or(one_bit(_lane_bit("_id", k))).alias(f"_lane{k}") for k in range(FILTER_LANES)]
    return ids.groupBy(block).agg(*lanes)


def _lane_bit(column: str, lane: int):
    return F.pmod(F.hash(F.lit(lane), F.col(column)), F.lit(64))


def filtered_events(events: DataFrame, codes: DataFrame, blocks: int = FILTER_BLOCKS) -> DataFrame:
    """Events whose code may be one of ``codes``: all of those that are, and few others.

    The filter has a bounded size and is broadcast, so this happens in the scan stage however many codes there are.
    """
    code = F.col("source_concept_id")
    tested = events.join(F.broadcast(code_filter(codes, blocks)), F.pmod(F.xxhash64(code), F.lit(blocks)) == F.col("_block"))
    passed = [bit_at(F.col(f"_lane{k}"), _lane_bit("source_concept_id", k)) == 1 for k in range(FILTER_LANES)]
    return tested.where(reduce(Column.__and__, passed)).select(*events.columns)


def _wanted(events: DataFrame, codes: DataFrame, small: bool) -> DataFrame:
    """Events of the given codes (column ``concept_id``); beyond the bound few others may be left.

    An inner join with distinct ids: a semi join would be pushed into every event table, each with a copy of the
    whole derivation of the codes.
    """
    if not small:
        return filtered_events(events, codes)
    ids = codes.select(F.col("concept_id").alias("_wanted")).distinct()
    return events.join(F.broadcast(ids), F.col("source_concept_id") == F.col("_wanted")).drop("_wanted")


KINDS = {SAME: "has_same", ADDED: "has_new", REMOVED: "has_old"}


def cohort_words(diff: DataFrame) -> DataFrame:
    """The cohorts of each code as bitmaps: ``concept_id, word`` and one bitmap for each kind.

    Cohort ``c`` is bit ``c mod WORD`` of word ``floor(c / WORD)``; a NULL cohort is bit 0 of a NULL word.
    """
    c, kind = F.col("cohort_definition_id"), F.col("concept_type")
    bit = F.coalesce(F.pmod(c, F.lit(WORD)), F.lit(0))
    marks = [F.bit_or(F.when(kind == k, one_bit(bit)).otherwise(F.lit(0).cast("long"))).alias(n) for k, n in KINDS.items()]
    return diff.groupBy("concept_id", F.floor(c / WORD).cast("long").alias("word")).agg(*marks)


def _per_cohort(words: DataFrame, *columns: str) -> DataFrame:
    """One row for each cohort that any bitmap holds: ``cohort_definition_id``, the columns, and a flag for each kind."""
    held = reduce(Column.bitwiseOR, [F.col(n) for n in KINDS.values()])
    rows = words.select(*columns, "word", *KINDS.values(), F.explode(bits_in(held)).alias("_bit"))
    flags = [bit_at(F.col(n), F.col("_bit")).cast("int").alias(n) for n in KINDS.values()]
    return rows.select((F.col("word") * WORD + F.col("_bit")).alias("cohort_definition_id"), *columns, *flags)


def _met(events: DataFrame, diff: DataFrame, small: bool) -> DataFrame:
    """Every event (or pair) once per word of cohorts that hold its code."""
    return events.join(broadcast_if(cohort_words(diff), small), F.col("source_concept_id") == F.col("concept_id"))


def matched_events(events: DataFrame, diff: DataFrame, small: bool = False) -> DataFrame:
    """``(cohort_definition_id, person_id, concept_type)``, one row per event and matching cohort.

    ``small``: the caller knows that the diff is bounded in bytes.
    """
    rows = _per_cohort(_met(_wanted(events, diff, small), diff, small), "person_id")
    kind = F.coalesce(*[F.when(F.col(n) == 1, F.lit(k)) for k, n in KINDS.items()])
    return rows.select("cohort_definition_id", "person_id", kind.alias("concept_type"))


def person_flags(events: DataFrame, diff: DataFrame, small: bool = False) -> DataFrame:
    """Per (cohort, person): ``has_same``, ``has_new``, ``has_old`` (INT 0/1).

    Only whether a person has a code matters, so events become distinct pairs before they meet the cohorts.
    """
    pairs = _wanted(events.select("person_id", "source_concept_id"), diff, small).distinct()
    words = _met(pairs, diff, small).groupBy("person_id", "word").agg(*[F.bit_or(n).alias(n) for n in KINDS.values()])
    return _per_cohort(words, "person_id").select("cohort_definition_id", "person_id", *KINDS.values())


def flag_histogram(flags: DataFrame) -> DataFrame:
    """Number of persons per (cohort, flag combination); NULL persons count 0."""
    return flags.groupBy("cohort_definition_id", "has_same", "has_new", "has_old").agg(
        F.count("person_id").alias("num_persons")
    )


def person_change_summary(histogram: DataFrame) -> DataFrame:
    """Per cohort: total, same, same without change, misclassification risk, new, lost."""
    s, n, o = F.col("has_same"), F.col("has_new"), F.col("has_old")
    num = F.col("num_persons")

    def total_if(cond):
        return F.sum(F.when(cond, num).otherwise(F.lit(0))).cast("bigint")

    same = (s == 1) | ((n == 1) & (o == 1))
    no_change = (s == 1) & (n == 0) & (o == 0)
    return histogram.groupBy("cohort_definition_id").agg(
        F.sum(num).cast("bigint").alias("total_persons"),
        total_if(same).alias("same_persons"),
        total_if(no_change).alias("same_persons_no_change"),
        (total_if(same) - total_if(no_change)).alias("same_persons_potential_index_misclassification"),
        total_if((s == 0) & (n == 1) & (o == 0)).alias("new_persons"),
        total_if((s == 0) & (n == 0) & (o == 1)).alias("lost_persons"),
    )


def person_change_summary_from_flags(flags: DataFrame) -> DataFrame:
    """:func:`person_change_summary` without the histogram stage (one aggregation).

    Summing histogram counts per flag condition equals counting the
    non-NULL persons that meet the condition.
    """
    s, n, o = F.col("has_same"), F.col("has_new"), F.col("has_old")
    person = F.col("person_id").isNotNull()

    def persons_if(cond):
        return count_if(person & cond)

    same = (s == 1) | ((n == 1) & (o == 1))
    no_change = (s == 1) & (n == 0) & (o == 0)
    return flags.groupBy("cohort_definition_id").agg(
        F.count("person_id").alias("total_persons"),
        persons_if(same).alias("same_persons"),
        persons_if(no_change).alias("same_persons_no_change"),
        (persons_if(same) - persons_if(no_change)).alias("same_persons_potential_index_misclassification"),
        persons_if((s == 0) & (n == 1) & (o == 0)).alias("new_persons"),
        persons_if((s == 0) & (n == 0) & (o == 1)).alias("lost_persons"),
    )


STATS_COLUMNS = (
    "cohort_definition_id",
    "cohortname",
    "total_persons",
    "same_persons",
    "same_persons_no_change",
    "same_persons_potential_index_misclassification",
    "new_persons",
    "lost_persons",
    "same_concepts_count",
    "removed_concepts_count",
    "added_concepts_count",
)


def cohort_stats(
    summary: DataFrame, count_change: DataFrame, cohort_names: DataFrame | None = None, sort: bool = True
) -> DataFrame:
    """The stats report, worst first (smallest share of unchanged persons)."""
    out = summary
    if cohort_names is not None:
        names = cohort_names.select(F.col("cohortid").alias("_name_id"), "cohortname")
        out = out.join(names, F.col("cohort_definition_id") == F.col("_name_id"), "left")
    else:
        out = out.withColumn("cohortname", F.lit(None).cast("string"))
    cc = count_change.withColumnRenamed("cohort_definition_id", "_cc_id")
    out = out.join(cc, F.col("cohort_definition_id") == F.col("_cc_id")).select(*STATS_COLUMNS)
    if sort:
        share = safe_ratio(F.col("same_persons_no_change"), F.col("total_persons"))
        out = out.orderBy(share.asc_nulls_first(), "cohort_definition_id")
    return out
