"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

The patterns are all windows of ``window`` consecutive words of the benchmark items (an item with fewer
words is one pattern of its own length).  For every pattern length there is one searcher:

* a *shift table* from a block of two words (one word for patterns of one word) to the distance that the
  search position may move on without passing an occurrence; a block in no pattern moves on by the whole
  pattern length less the block, so most document words are never looked at;
* *suffix buckets* from a block with shift 0 to the patterns that end in it;
* a direct comparison of the words, so every reported occurrence is exact.

The pattern set is broadcast in groups of at most ``patterns_per_pass`` patterns.  A benchmark beyond that
bound is searched in several passes over the documents whose hits are merged per document: nothing is
dropped, only the number of passes grows with the benchmark.

Defined cases: a null or wordless text has ``n_words`` 0 and no hits; null or wordless items have no
window; items with equal ids count once; windows that several items share report all of them; every input
row gives one output row, repeated rows included; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabshift.llm.common import map_rows, stored, text_slices

WINDOW = 10
PATTERNS_PER_PASS = 200_000
SLICE_BYTES, SLICE_ROWS = 4_000_000, 1_024
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

SCHEMA = "n_words long, hits array<struct<first:long,end:long>>, items array<string>"


def words(text: str | None) -> list[str]:
    """The words of a text: A-Z lower-cased, runs of digits, a-z and everything beyond ASCII."""
    return WORD.findall(text.translate(LOWER)) if text else []


class Searcher:
    """Wu-Manber tables for patterns (word tuples) of one length."""

    def __init__(self, patterns: list[tuple[str, ...]]):
        self.length = m = len(patterns[0])
        self.block = b = min(2, m)
        self.shift: dict = {}
        self.buckets: dict = {}
        for p in patterns:
            for end in range(b, m + 1):
                key = p[end - b : end]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.buckets.setdefault(p[m - b :], set()).add(p)
        self.default = m - b + 1

    def find(self, text: list[str]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(end, pattern) of every occurrence, in order of the end."""
        m, b, shift, default = self.length, self.block, self.shift, self.default
        at, n = m, len(text)
        while at <= n:
            key = tuple(text[at - b : at])
            step = shift.get(key, default)
            if step:
                at += step
                continue
            window = tuple(text[at - m : at])
            if window in self.buckets[key]:
                yield at, window
            at += 1


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """One row per distinct pattern with the sorted distinct ids (as text) of the items that hold it."""

    def cut(batches):
        for batch in batches:
            out_p, out_i = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                if not w or item is None:
                    continue
                found = {tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1))}
                for p in sorted(found):
                    out_p.append(list(p))
                    out_i.append(item)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_p, pa.list_(pa.string())), pa.array(out_i, pa.string())], ["pattern", "item"]
            )

    rows = map_rows(
        benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")),
        cut,
        "pattern array<string>, item string",
    )
    return rows.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _search(batches, patterns: dict[tuple[str, ...], list[str]], width: int, text_at: int):
    """Adds the occurrences of ``patterns`` to the hits and items that earlier passes found.

    A batch has ``width`` columns that go through, the text among them, and from the second pass on what was found.
    """
    by_length: dict[int, list] = {}
    for p in patterns:
        by_length.setdefault(len(p), []).append(p)
    searchers = [Searcher(ps) for ps in by_length.values()]
    for batch, texts in (x for b in batches for x in text_slices(b, text_at, SLICE_BYTES, SLICE_ROWS)):
        later = batch.num_columns > width
        old_hits = batch.column(width + 1).to_pylist() if later else [[]] * len(texts)
        old_items = batch.column(width + 2).to_pylist() if later else [[]] * len(texts)
        n_words, all_hits, all_items = [], [], []
        for text, hits, known in zip(texts, old_hits, old_items, strict=True):
            w = words(text)
            spans = [(h["first"], h["end"]) for h in hits]
            items = set(known)
            for s in searchers:
                for end, p in s.find(w):
                    spans.append((end - len(p), end))
                    items.update(patterns[p])
            merged: list[list[int]] = []
            for first, end in sorted(spans):
                if merged and first <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([first, end])
            n_words.append(len(w))
            all_hits.append([{"first": f, "end": e} for f, e in merged])
            all_items.append(sorted(items))
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:width],
                pa.array(n_words, pa.int64()),
                pa.array(all_hits, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                pa.array(all_items, pa.list_(pa.string())),
            ],
            [*batch.schema.names[:width], "n_words", "hits", "items"],
        )


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_col: str = "item_id",
    window: int = WINDOW,
    patterns_per_pass: int = PATTERNS_PER_PASS,
) -> DataFrame:
    """``keep`` columns + n_words, n_hit, hits (word ranges, end exclusive, merged) and items (sorted ids).

    ``hits`` are the document's word ranges that lie inside any occurrence.  With more patterns than one
    pass takes, every pass stores the documents with what was found so far and the next one adds to it.
    """
    pats = item_windows(benchmark, item_col, "text", window)
    groups = max(1, -(-pats.count() // patterns_per_pass))
    if groups > 1:
        pats = stored(pats.withColumn("g", F.pmod(F.xxhash64("pattern"), F.lit(groups))), "patterns")
    through = [*keep, *([] if text_col in keep else [text_col])]
    source = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(through)])
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    found = source
    for g in range(groups):
        part = pats.where(F.col("g") == g) if groups > 1 else pats
        table = {tuple(r["pattern"]): r["items"] for r in part.toLocalIterator()}
        found = map_rows(found, lambda it, t=table: _search(it, t, len(through), through.index(text_col)), f"{base}, {SCHEMA}")
        if g + 1 < groups:
            found = stored(found, f"decontam-{g}")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["end"] - h["first"])
    kept = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    return found.select(*kept, "n_words", n_hit.alias("n_hit"), "hits", "items")


def report(found: DataFrame) -> DataFrame:
    """The per-document digest columns of ``contamination``."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS p
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS k FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), lengths AS (SELECT DISTINCT m FROM item_windows
), doc_windows AS (
  SELECT r, m, k, array_to_string(list_slice(w, k, k + m - 1), ' ') AS p
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM doc_words, lengths WHERE len(w) >= m)
), found AS (
  SELECT d.r, d.m, d.k, i.item FROM doc_windows d JOIN item_windows i ON d.m = i.m AND d.p = i.p
), hit AS (
  SELECT r, count(DISTINCT word_at) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS word_at FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
