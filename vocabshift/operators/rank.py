"""Places of rows in a total order, or in the order of their group, without one task for a whole table or group.

``row_number`` sorts a window partition in one task: the whole table, or all of a group that holds a third of the rows.
Here the rows are dealt by ranges of the order and sorted there; the counts of each range say how many rows come before it, and
a row's place is that plus its place in its range.  Rows of one group may lie in many ranges.

Rows that are equal in all order columns get different places, in no defined order among them; nulls are placed as the order
says, and null group values form a group.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Staging


def ranked(
    df: DataFrame, order: Sequence[Column | str], staging: Staging, name: str = "place", group: Sequence[str] = (), keep: Sequence[Column | str] = ("*",)
) -> DataFrame:
    """``keep`` (default: all columns) + ``name``: the place (from 1) of each row in its group, or in the table.

    The sorted rows are staged, since two evaluations of a range partitioning need not agree.  ``keep`` names what to stage
    besides the group, so that columns that only the order needs are not written.
    """
    by = [*map(F.col, group), *[F.col(c) if isinstance(c, str) else c for c in order]]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    held = staging.put(
        dealt.select(*keep, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "ranked"
    )
    starts = held.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shift = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1
    offsets = starts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_range").alias("_in"), shift.alias("_shift"))
    if not group:
        offsets = F.broadcast(offsets)  # one row a range
    on = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group], F.col("_range") == F.col("_in"))
    kept = [c for c in held.columns if c not in ("_range", "_at")]
    return held.join(offsets, on).select(*kept, (F.col("_at") + F.col("_shift")).alias(name))
