"""Broadcast of sides with a known bound on their bytes.

A broadcast hint is only placed on a side whose size is bounded:

* ``fits``: by Spark's own statistics, which start no job.  These are file
  sizes for a table (and upper estimates for what is derived from it: a
  join counts as the product of its inputs).  Files are compressed, so they
  are taken ``EXPANSION`` times (items with repeated names: 18 times in memory).
* ``rows_fit``: by the counted rows of a staged table and the bytes of a row
  of fixed width.

Beyond the bound the join is left to the planner: sort-merge, with AQE
splitting skewed partitions and switching to a broadcast when a finished
stage proves small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024

EXPANSION = 32  # memory bytes taken for a byte of the statistics

CONF_KEY = "vocabshift.broadcast.maxBytes"


def known_bytes(df: DataFrame) -> int:
    """The size of ``df`` by Spark's statistics, with room for compression (no job)."""
    return EXPANSION * int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _bound(df: DataFrame, max_bytes: int | None) -> int:
    if max_bytes is None:
        max_bytes = int(df.sparkSession.conf.get(CONF_KEY, str(DEFAULT_MAX_BROADCAST_BYTES)))
    return max_bytes


def fits(*frames: DataFrame, max_bytes: int | None = None) -> bool:
    """True when the frames together have at most ``max_bytes`` bytes by Spark's statistics."""
    return sum(known_bytes(df) for df in frames) <= _bound(frames[0], max_bytes)


def rows_fit(table: DataFrame, row_bytes: int, max_bytes: int | None = None) -> bool:
    """True when the counted rows of a staged table, of ``row_bytes`` each, have at most ``max_bytes`` bytes."""
    return table.count() * row_bytes <= _bound(table, max_bytes)


def broadcast_if(df: DataFrame, known_small: bool) -> DataFrame:
    """``broadcast(df)`` when the caller knows its bound (see :func:`fits`)."""
    return F.broadcast(df) if known_small else df
