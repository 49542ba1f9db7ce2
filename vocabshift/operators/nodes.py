"""Non-standard nodes: concept-set items whose concept is not standard in the new version.

For every item (excluded or not, duplicates kept) whose node has a NULL
``standard_concept`` in the new ``concept`` table: its descendant record
count (0 when absent), and its valid ``Maps to`` and ``Maps to value``
targets.  The two target lists are independent LEFT joins, so a node with
*m* and *n* targets yields *m x n* rows; that fan-out is the report's
meaning and is not de-duplicated.

Plan: the non-standard concepts among the items' nodes are found first, with one
scan of ``concept``; their ids, a subset of the items' ids, filter one scan of
the counts and one of the relationships.  A node's valid edges of both types
are gathered into one row per node, so they are read once and the fan-out is
two ``explode``s.  Everything after the filters is as small as the items are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MAPS_TO, MAPS_TO_VALUE, SET_KEYS, Vocabulary
from ..plans.broadcast import broadcast_if, fits

NODE_COLUMNS = (
    "node_concept_id",
    "node_concept_name",
    "drc",
    "maps_to_concept_id",
    "maps_to_concept_name",
    "maps_to_value_concept_id",
    "maps_to_value_concept_name",
)


def node_targets(vocab: Vocabulary, node_ids: DataFrame, small: bool) -> DataFrame:
    """``_node, maps_to, maps_to_value``: the valid targets (id, name) of every node that has some.

    The id and name are NULL where the target is missing from ``concept``.
    """
    edges = (
        vocab.relationship.where(
            F.col("relationship_id").isin(MAPS_TO, MAPS_TO_VALUE) & F.col("invalid_reason").isNull()
        )
        .select(F.col("concept_id_1").alias("_node"), F.col("concept_id_2").alias("_to"), "relationship_id")
        .join(broadcast_if(node_ids, small), F.col("_node") == F.col("_nid"), "left_semi")
    )
    names = vocab.concept.select(F.col("concept_id").alias("id"), F.col("concept_name").alias("name"))
    target = F.struct("id", "name")
    of = lambda kind: F.collect_list(F.when(F.col("relationship_id") == kind, target))
    named = edges.join(names, F.col("_to") == F.col("id"), "left")
    return named.groupBy("_node").agg(of(MAPS_TO).alias("maps_to"), of(MAPS_TO_VALUE).alias("maps_to_value"))


def nonstandard_nodes(
    items: DataFrame,
    new: Vocabulary,
    counts: DataFrame,
    keys: Sequence[str] = SET_KEYS,
    small: bool | None = None,
    sort: bool = True,
) -> DataFrame:
    """The non-standard node report (largest descendant record count first)."""
    small = fits(items) if small is None else small
    it = items.select(*keys, "isexcluded", "includedescendants", "conceptid")
    cn = new.concept.where(F.col("standard_concept").isNull()).select(
        F.col("concept_id").alias("node_concept_id"), F.col("concept_name").alias("node_concept_name")
    )
    wanted = items.select(F.col("conceptid").alias("_wanted")).distinct()
    nodes = cn.join(broadcast_if(wanted, small), F.col("node_concept_id") == F.col("_wanted"), "left_semi")
    node_ids = nodes.select(F.col("node_concept_id").alias("_nid")).distinct()
    drc = counts.select(F.col("concept_id").alias("_cnt_node"), "descendant_record_count").join(
        broadcast_if(node_ids, small), F.col("_cnt_node") == F.col("_nid"), "left_semi"
    )
    out = (
        it.join(nodes, F.col("node_concept_id") == F.col("conceptid"))
        .join(drc, F.col("node_concept_id") == F.col("_cnt_node"), "left")
        .join(node_targets(new, node_ids, small), F.col("node_concept_id") == F.col("_node"), "left")
        .withColumn("_to", F.explode_outer("maps_to"))
        .withColumn("_value", F.explode_outer("maps_to_value"))
        .select(
            *keys,
            "isexcluded",
            "includedescendants",
            "node_concept_id",
            "node_concept_name",
            F.coalesce(F.col("descendant_record_count"), F.lit(0).cast("bigint")).alias("drc"),
            F.col("_to.id").alias("maps_to_concept_id"),
            F.col("_to.name").alias("maps_to_concept_name"),
            F.col("_value.id").alias("maps_to_value_concept_id"),
            F.col("_value.name").alias("maps_to_value_concept_name"),
        )
    )
    return out.orderBy(*report_order(keys)) if sort else out


def report_order(keys: Sequence[str] = SET_KEYS) -> list:
    """Largest descendant record count first; the other columns split ties, so no range holds all zeros."""
    ties = ("node_concept_id", "isexcluded", "includedescendants", "maps_to_concept_id", "maps_to_value_concept_id")
    return [F.col("drc").desc(), *keys, *ties]
