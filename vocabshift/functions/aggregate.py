"""Ordered, NULL-preserving string aggregation.

The report shows all targets of one source code as ``'-'``-joined lists,
one list per attribute (id, name, vocabulary, code).  The lists are ordered
by target id with missing targets last, a missing value is spelled ``NA``,
and the four lists stay position-aligned because they are cut from one
sorted array of structs.

Implementation: ``collect_list(struct(...))`` -> ``array_sort`` ->
``transform`` -> ``array_join``.  All built-in expressions, so the
aggregate runs as an ordinary (partial + final) hash aggregate on the
executors; one group holds the targets of one source code only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NA = "NA"


def sorted_struct_list(order_by: str, values: Sequence[str], where: Column | None = None) -> Column:
    """Array of ``struct(is_null, order_by, *values)`` sorted NULLs last.

    ``array_sort`` orders structs field by field with NULL fields first,
    so a leading ``isNull`` flag moves missing ids to the end.  The value
    fields act as tie-breakers, which keeps the result deterministic.
    With ``where``, only rows meeting it are collected (``collect_list``
    skips the NULL structs of the others).
    """
    fields = [F.col(order_by).isNull().alias("_null"), F.col(order_by).alias(order_by)]
    fields += [F.col(v).alias(v) for v in values if v != order_by]
    item = F.struct(*fields)
    if where is not None:
        item = F.when(where, item)
    return F.array_sort(F.collect_list(item))


def join_field(sorted_list: Column, field: str, sep: str = "-") -> Column:
    """``'-'``-joined text of one struct field, NULL spelled ``NA``."""
    return F.array_join(
        F.transform(sorted_list, lambda s: F.coalesce(s[field].cast("string"), F.lit(NA))), sep
    )


def ordered_join_columns(
    order_by: str, values: Sequence[str], prefix: str, sep: str = "-", where: Column | None = None
) -> list[Column]:
    """Aggregate expressions ``<prefix>_<value>`` for each value column.

    To be used inside ``groupBy(...).agg(*cols)``.  The sort happens once
    per group; each output column is a projection of the same sorted array.
    ``where`` restricts the rows that contribute.
    """
    sorted_list = sorted_struct_list(order_by, values, where)
    return [join_field(sorted_list, v, sep).alias(f"{prefix}{v}") for v in values]
