"""Pattern spans by DataFrame functions only: code-point offsets of regular-expression matches.

``split`` on a pattern gives the gaps between its matches and ``regexp_extract_all`` the matches; running
sums of their lengths are the offsets.  The sums are taken in blocks, so a text with very many matches costs
about ``BLOCK`` copies a match and not one copy for every earlier match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once (a lambda body would compute it again for every element)."""
    return F.transform(F.array(value), body)[0]


def _running(sizes: Column, start: Column) -> Column:
    """Running sums of a short array, each including its own element."""
    none = F.array().cast("array<int>")
    return F.aggregate(
        sizes,
        F.struct(start.alias("sum"), none.alias("sums")),
        lambda acc, x: F.struct(
            (acc["sum"] + x).alias("sum"), F.concat(acc["sums"], F.array(acc["sum"] + x)).alias("sums")
        ),
        lambda acc: acc["sums"],
    )


def running_sums(sizes: Column) -> Column:
    """Inclusive running sums of an int array that is not empty."""

    def of(sizes: Column) -> Column:
        last = F.ceil(F.size(sizes) / F.lit(BLOCK)).cast("int") - 1
        cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))
        return let(cut, summed)

    def summed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        bases = let(totals, lambda t: F.zip_with(_running(t, F.lit(0)), t, lambda upto, own: upto - own))
        return F.flatten(F.zip_with(blocks, bases, _running))

    return let(sizes, of)


NO_SPANS = "array<struct<start:int,end:int,match:string>>"


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start:int,end:int,match:string>> of the leftmost non-overlapping matches."""

    def of(matches: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
        spans = F.zip_with(
            running_sums(steps),
            matches,
            lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")),
        )
        return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(NO_SPANS))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def tagged(kind: str, rank: int, spans: Column) -> Column:
    """Spans with their kind, as structs that sort by start, then kind."""
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
                                  F.lit(kind).alias("kind"), s["match"].alias("match"))
    )


TAGGED = "array<struct<start:int,rank:int,end:int,kind:string,match:string>>"


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
