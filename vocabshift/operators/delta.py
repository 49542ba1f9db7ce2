"""Resolution by words of sets, and the code difference from what changed between the versions.

A concept set is a bit: sets are numbered, 64 of them share a *word*, and a concept's sets are a few (word, bits) rows.

* **Resolution** (``resolve_words``): a node's items become one row per word (include bits and exclude bits), which is
  expanded to the node's descendants once for 64 sets; bits are OR-ed per descendant and word, and the sets are include AND
  NOT exclude.  No (set, descendant) row exists before that difference.
* **Difference** (``changed_codes``): a code can be removed from, or added to, a set only by a concept that
  entered or left the set, or by an edge that is in one version only.  These give candidate (code, word) rows; only their
  edges of both versions are looked at again, to see in which of the 64 sets the code is on one side only.  Sets and
  concepts that nothing touched meet no edge, and a concept in many sets with many codes costs a 64th of their product even
  where it changed.

Rows are equal to those of ``resolve.resolve_concepts`` and ``diff.source_concept_diff``.  Null key columns are values like
any other (two nulls are equal), repeated items and edges change nothing, empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import bits_in, one_bit
from ..functions.columns import not_in
from ..model import MAPPED_FROM, SET_KEYS, Vocabulary
from ..plans.broadcast import broadcast_if, fits
from .diff import ADDED, REMOVED

GROUPS = 16  # numberings side by side, so that no task numbers all sets
WORD_BITS = 64


def _bits_if(cond: Column, bits: Column) -> Column:
    return F.when(cond, bits).otherwise(F.lit(0).cast("bigint"))


def numbered(items: DataFrame, keys: Sequence[str] = SET_KEYS) -> DataFrame:
    """``items`` + ``_word``, ``_bit``: the place of each row's set, the same in every row of the set."""
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS))
    place = F.dense_rank().over(Window.partitionBy("_group").orderBy(*keys)) - 1
    dealt = items.withColumn("_group", group).withColumn("_place", place)
    word = F.floor(F.col("_place") / WORD_BITS) * GROUPS + F.col("_group")
    return dealt.select(*items.columns, word.cast("bigint").alias("_word"), (F.col("_place") % WORD_BITS).cast("int").alias("_bit"))


def sets_of(items: DataFrame, keys: Sequence[str] = SET_KEYS) -> DataFrame:
    """``_word, _bit, keys`` of every set of numbered items."""
    return items.select("_word", "_bit", *keys).distinct()


def resolve_words(
    items: DataFrame, vocab: Vocabulary, excluded_nodes: Iterable[int] | None = (), small: bool | None = None
) -> DataFrame:
    """``descendant_concept_id, _word, bits``: the resolved sets (of numbered items) that hold a concept."""
    small = fits(items) if small is None else small
    include = (F.col("isexcluded") == 0) & not_in(F.col("conceptid"), excluded_nodes)
    exclude = F.col("isexcluded") == 1
    bit = one_bit(F.col("_bit"))
    nodes = (
        items.where((include | exclude) & F.col("includedescendants").isNotNull())
        .groupBy(F.col("conceptid").alias("_node"), (F.col("includedescendants") != 0).alias("_deep"), "_word")
        .agg(F.bit_or(_bits_if(include, bit)).alias("_inc"), F.bit_or(_bits_if(exclude, bit)).alias("_exc"))
    )
    known = vocab.concept.select(F.col("concept_id").alias("_known"))
    ids = nodes.select(F.col("_node").alias("_id")).distinct()
    known = known.join(broadcast_if(ids, small), F.col("_known") == F.col("_id"), "left_semi").distinct()
    nodes = nodes.join(broadcast_if(known, small), F.col("_node") == F.col("_known"), "left_semi")
    tree = vocab.ancestor.select("ancestor_concept_id", "descendant_concept_id")
    a, d = F.col("ancestor_concept_id"), F.col("descendant_concept_id")
    reached = tree.join(broadcast_if(nodes, small), (a == F.col("_node")) & (F.col("_deep") | (a == d)))
    merged = reached.groupBy("descendant_concept_id", "_word").agg(F.bit_or("_inc").alias("_inc"), F.bit_or("_exc").alias("_exc"))
    bits = F.col("_inc").bitwiseAND(F.bitwise_not("_exc"))
    return merged.select("descendant_concept_id", "_word", bits.alias("bits")).where("bits <> 0")


def set_rows(words: DataFrame, sets: DataFrame, bits: str = "bits", small: bool | None = None) -> DataFrame:
    """``words`` with a row for every set of ``bits``: the other columns and the set's keys."""
    small = fits(sets) if small is None else small
    kept = [c for c in words.columns if c not in ("_word", bits)]
    keys = [c for c in sets.columns if c not in ("_word", "_bit")]
    bit = words.withColumn("_bit", F.explode(bits_in(F.col(bits))))
    return bit.join(broadcast_if(sets, small), ["_word", "_bit"]).select(*keys, *kept)


def resolve_concepts_by_words(
    items: DataFrame,
    vocab: Vocabulary,
    excluded_nodes: Iterable[int] | None = (),
    keys: Sequence[str] = SET_KEYS,
    small: bool | None = None,
) -> DataFrame:
    """Resolved concept sets, ``keys + descendant_concept_id``: equal to ``resolve.resolve_concepts``."""
    held = numbered(items, keys)
    small = fits(items) if small is None else small
    found = set_rows(resolve_words(held, vocab, excluded_nodes, small), sets_of(held, keys), small=small)
    return found.select(*keys, "descendant_concept_id")


def _sides(old: DataFrame, new: DataFrame, by: Sequence[str], value: Column, before: str, after: str) -> DataFrame:
    """``by`` with the value in the old and in the new version (0 where absent), OR-ed over equal rows: one aggregation."""
    none = F.lit(0).cast("bigint")
    both = old.select(*by, value.alias(before), none.alias(after)).unionByName(
        new.select(*by, none.alias(before), value.alias(after))
    )
    return both.groupBy(*by).agg(F.bit_or(before).alias(before), F.bit_or(after).alias(after))


def concept_sides(old_words: DataFrame, new_words: DataFrame) -> DataFrame:
    """``concept, _word, was, now``: the sets that hold a concept in the old and in the new version."""
    sides = _sides(old_words, new_words, ["descendant_concept_id", "_word"], F.col("bits"), "was", "now")
    return sides.withColumnRenamed("descendant_concept_id", "concept")


def edge_sides(old: Vocabulary, new: Vocabulary, valid_only: bool = True) -> DataFrame:
    """``standard, code, before, after``: the source edges, with -1 (all bits) for a version that has the edge and 0 for one that has not."""
    all_bits = F.lit(-1).cast("bigint")
    sides = [v.edges(MAPPED_FROM, valid_only) for v in (old, new)]
    found = _sides(*sides, ["concept_id_1", "concept_id_2"], all_bits, "before", "after")
    return found.withColumnsRenamed({"concept_id_1": "standard", "concept_id_2": "code"})


def candidates(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """``code, _word``: the only places where a code can be on one side of a set.

    Reached by a concept whose sets changed or by an edge in one version only.
    """
    on = F.col("concept") == F.col("standard")
    moved = concepts.where("was <> now").join(edges, on)
    rewired = concepts.join(edges.where("before <> after"), on)
    return moved.select("code", "_word").unionByName(rewired.select("code", "_word")).distinct()


def changed_codes(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """``source_concept_id, _word, action, bits``: the sets that lost (``Removed``) or gained (``Added``) a code."""
    places = candidates(concepts, edges).select(F.col("code").alias("_code"), "_word")
    again = places.join(edges, F.col("_code").eqNullSafe(F.col("code"))).drop("_code")
    holders = concepts.withColumnRenamed("_word", "_of")
    met = again.join(holders, (F.col("standard") == F.col("concept")) & (F.col("_word") == F.col("_of")))
    side = lambda edge, sets: F.bit_or(F.col(edge).bitwiseAND(F.col(sets)))
    seen = met.groupBy("code", "_word").agg(side("before", "was").alias("_was"), side("after", "now").alias("_now"))
    one_sided = lambda a, b: F.col(a).bitwiseAND(F.bitwise_not(b))
    action = lambda name, bits: F.struct(F.lit(name).alias("action"), bits.alias("bits"))
    both = F.array(action(REMOVED, one_sided("_was", "_now")), action(ADDED, one_sided("_now", "_was")))
    return (
        seen.select(F.col("code").alias("source_concept_id"), "_word", F.explode(both).alias("_change"))
        .select("source_concept_id", "_word", "_change.action", "_change.bits")
        .where("bits <> 0")
    )


def source_concept_diff_by_delta(
    items: DataFrame,
    old: Vocabulary,
    new: Vocabulary,
    excluded_nodes: Iterable[int] | None = (),
    keys: Sequence[str] = SET_KEYS,
    small: bool | None = None,
    hold=lambda df, name: df,
) -> DataFrame:
    """Removed / Added source codes per concept set: equal to ``diff.source_concept_diff`` of both versions.

    ``hold(df, name)`` may write what is read several times (the sets of each concept, the edges of both versions).
    """
    small = fits(items) if small is None else small
    held = numbered(items, keys)
    words = [resolve_words(held, v, excluded_nodes, small) for v in (old, new)]
    concepts = hold(concept_sides(*words), "concept_sides")
    edges = hold(edge_sides(old, new), "edge_sides")
    found = set_rows(changed_codes(concepts, edges), sets_of(held, keys), small=small)
    return found.select(*keys, "source_concept_id", "action")
