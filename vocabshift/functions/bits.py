"""Bitmaps in BIGINT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_bit(bit: Column) -> Column:
    """A BIGINT with one bit set (0 to 63)."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))


def bit_at(word: Column, bit: Column) -> Column:
    """0 or 1: one bit of a BIGINT."""
    return F.getbit(word, bit.cast("int"))


def bits_in(word: Column) -> Column:
    """The places of the bits that are set, ascending."""
    places = F.sequence(F.lit(0), F.lit(63))
    return F.filter(places, lambda b: bit_at(word, b) == 1)
