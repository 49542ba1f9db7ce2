"""Concept-set resolution (included nodes minus excluded nodes, with descendants).

Semantics (per concept set, keyed by ``keys``):

* an item resolves only if its node exists in the version's ``concept``
  table;
* the node expands through ``concept_ancestor``: to itself only (needs a
  self row) when ``includedescendants = 0``, to all descendants otherwise;
  a NULL flag matches neither;
* items with ``isexcluded = 0`` whose node is not in ``excluded_nodes`` add
  concepts, items with ``isexcluded = 1`` remove them (the exclusion list
  does not apply to them); other flag values do neither;
* the result is a set (distinct rows).

Plan: the item table, read once (broadcast while its bytes are bounded), meets
one scan of ``concept`` (which of its nodes exist) and then one scan of
``concept_ancestor``; include and exclude rows are tagged in the same pass and
reduced by one hash aggregate keyed on ``keys + descendant``, which is the set
difference without a second scan of the hierarchy.  The rows are dealt by that
key first: a node with many descendants, or in many sets, would fill the hash
table of the one task that expands it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag, not_in
from ..model import SET_KEYS, Vocabulary
from ..plans.broadcast import broadcast_if, fits


def expand_items(
    items: DataFrame,
    vocab: Vocabulary,
    excluded_nodes: Iterable[int] | None = (),
    keys: Sequence[str] = SET_KEYS,
    small: bool | None = None,
) -> DataFrame:
    """``keys + descendant_concept_id`` rows tagged ``_inc`` / ``_exc`` (INT 0/1)."""
    small = fits(items) if small is None else small
    conceptid = F.col("conceptid")
    include = (F.col("isexcluded") == 0) & not_in(conceptid, excluded_nodes)
    exclude = F.col("isexcluded") == 1
    tagged = (
        items.where(include | exclude)
        .select(*keys, "conceptid", "includedescendants", flag(include).alias("_inc"), flag(exclude).alias("_exc"))
    )
    # A node that the concept table repeats repeats its rows, which no set operation below sees.
    ids = vocab.concept.select(F.col("concept_id").alias("_node_id"))
    nodes = ids.join(broadcast_if(tagged, small), F.col("_node_id") == conceptid).drop("_node_id")
    anc = vocab.ancestor.select("ancestor_concept_id", "descendant_concept_id")
    a, d = F.col("ancestor_concept_id"), F.col("descendant_concept_id")
    desc = F.col("includedescendants")
    cond = (a == conceptid) & (((desc == 0) & (a == d)) | (desc != 0))
    return anc.join(broadcast_if(nodes, small), cond).select(*keys, "descendant_concept_id", "_inc", "_exc")


def resolve_concepts(
    items: DataFrame,
    vocab: Vocabulary,
    excluded_nodes: Iterable[int] | None = (),
    keys: Sequence[str] = SET_KEYS,
    small: bool | None = None,
) -> DataFrame:
    """Resolved concept sets: ``keys + descendant_concept_id``, distinct."""
    expanded = expand_items(items, vocab, excluded_nodes, keys, small)
    return (
        expanded.repartition(*keys, "descendant_concept_id")
        .groupBy(*keys, "descendant_concept_id")
        .agg(F.max("_inc").alias("_inc"), F.max("_exc").alias("_exc"))
        .where((F.col("_inc") == 1) & (F.col("_exc") == 0))
        .select(*keys, "descendant_concept_id")
    )


def resolve_concepts_two_pass(
    items: DataFrame,
    vocab: Vocabulary,
    excluded_nodes: Iterable[int] | None = (),
    keys: Sequence[str] = SET_KEYS,
    small: bool | None = None,
) -> DataFrame:
    """Same result as :func:`resolve_concepts`, written as ``include EXCEPT exclude``.

    Kept as the literal form of the definition (used by property tests).
    """
    expanded = expand_items(items, vocab, excluded_nodes, keys, small)
    cols = [*keys, "descendant_concept_id"]
    inc = expanded.where(F.col("_inc") == 1).select(*cols)
    exc = expanded.where(F.col("_exc") == 1).select(*cols)
    return inc.subtract(exc)


def included_concepts(
    items: DataFrame,
    vocab: Vocabulary,
    excluded_nodes: Iterable[int] | None = (),
    keys: Sequence[str] = SET_KEYS,
    small: bool | None = None,
) -> DataFrame:
    """Include branch only (no exclusions applied), distinct."""
    expanded = expand_items(items.where(F.col("isexcluded") == 0), vocab, excluded_nodes, keys, small)
    return expanded.select(*keys, "descendant_concept_id").distinct()


def translate_cohort_ids(df: DataFrame, cohort_map: DataFrame, small: bool | None = None) -> DataFrame:
    """Replace new cohort ids by their old ids (``new_cohort_id -> old_cohort_id``).

    Rows of cohorts absent from the map are dropped (inner join); a new
    cohort paired with two old ones yields two rows.
    """
    m = cohort_map.select("old_cohort_id", "new_cohort_id")
    small = fits(m) if small is None else small
    cols = [c for c in df.columns if c != "cohortid"]
    return (
        df.join(broadcast_if(m, small), F.col("cohortid") == F.col("new_cohort_id"))
        .select(F.col("old_cohort_id").alias("cohortid"), *cols)
    )
