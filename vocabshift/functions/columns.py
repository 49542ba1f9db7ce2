"""Small column helpers: flags, NULL-safe keys, ratios, header names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """``CASE WHEN cond THEN 1 ELSE 0 END`` as INT."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_if(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` as BIGINT."""
    return F.sum(flag(cond)).cast("bigint")


def safe_ratio(num: Column, den: Column) -> Column:
    """``num * 1.0 / den``; NULL instead of an error when ``den`` is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def not_in(c: Column, values: Iterable | None) -> Column:
    """``c NOT IN (values)``; always true for an empty list or ``None``."""
    values = list(values or [])
    return ~c.isin(values) if values else F.lit(True)


def is_in(c: Column, values: Iterable | None) -> Column:
    """``c IN (values)``; ``None`` means no filter (all values pass)."""
    if values is None:
        return F.lit(True)
    return c.isin(list(values))


def camel_case(name: str) -> str:
    """``same_persons_no_change`` -> ``samePersonsNoChange``."""
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def to_camel_case(df: DataFrame) -> DataFrame:
    """Rename every column to camelCase (report headers)."""
    return df.toDF(*[camel_case(c) for c in df.columns])
