"""Removal of passages that repeat across documents: winnowed seeds, extended both ways to maximal repeats.

A window is ``length`` consecutive words of one document.  A word goes if a window that covers it also starts in a document
with a smaller id, which is the same as lying in a maximal repeat of at least ``length`` words shared with such a document.

1. *Anchors*: of the ``length - SEED + 1`` runs of ``SEED`` words inside a window the one with the least hash (the last of
   equals) is the window's anchor.  Equal windows so have equal anchors at the same place, and neighbouring windows mostly
   the same one: about one word in twenty begins an anchor.  An occurrence of an anchor stands for the row of windows that
   chose it, which is how far a match through it can reach to either side before other anchors take over.
2. *Seeds*: anchors that occur in one document only fall away.
3. *Extension as a whole*: occurrences of an anchor whose reach is equal on both sides form a class.  All of a class but
   those in its smallest document match over the whole reach.
4. *Extension word by word*: where an anchor has several classes, their first occurrences are extended from the texts:
   each window of the reach, as far left and right of the anchor as it goes, is compared with those of the other classes by
   a 128-bit hash.  A passage with thousands of copies so costs its occurrences, never their pairs.
5. *Maximal repeats*: matched windows of a document are merged to ranges of words.

Occurrences and classes are told apart by the anchor's and the reach's 64-bit hashes together, windows by two 64-bit hashes of
different functions.  Every step is a join or an aggregation with partial sums; keys that hold many rows are broadcast
(``many_to_one``).

Defined cases: null texts have no words; rows with a null id lose nothing and are nobody's source; rows that repeat an id
do not remove each other, and each is judged by its own text; an empty table gives no rows; other columns stay if named in
``keep``, whatever their names; windows are judged on the input, so what goes is no less a source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabshift.llm.common import discard, many_to_one, map_rows, stored, text_slices
from vocabshift.llm.shingles import MIX, STEP, _mixed, word_hashes

LENGTH = 50
SEED = 10
SLICE_BYTES, SLICE_ROWS = 1_000_000, 1_024
PIECE_BYTES = 4_000_000
BLOCK = 1 << 19
SPACE = b" \t\n\v\f\r"
KEY = ("doc", "print")  # a document: its id and a hash of its text


# -- hashes of word windows -----------------------------------------------------------------------------------


def _pieces(text: str) -> list[str]:
    """A long text in pieces that end before a white space."""
    out, at = [], 0
    while len(text) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < len(text) and text[end] not in " \t\n\v\f\r":
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, words per text), long texts piece by piece."""
    if all(len(t or "") <= PIECE_BYTES for t in texts):
        return word_hashes(texts, lower=False)
    hashes, counts = [], []
    for t in texts:
        parts = [word_hashes([p], lower=False)[0] for p in _pieces(t or "")]
        hashes += parts
        counts.append(sum(map(len, parts)))
    return np.concatenate(hashes), np.array(counts)


def run_hashes(h: np.ndarray, sizes: tuple[int, ...], factor: np.uint64 = STEP) -> list[np.ndarray]:
    """For each of the ascending ``sizes`` the hashes of all runs of so many words, by doubling."""
    out, width, cur = [], 1, _mixed(h ^ factor)
    for size in sizes:
        while 2 * width <= size:
            cur = _mixed(cur[: max(0, len(cur) - width)] * factor + cur[width:])
            width *= 2
        n = max(0, len(h) - size + 1)
        out.append(_mixed(cur[:n] * factor + cur[size - width : size - width + n] + np.uint64(size)))
    return out


def least_of(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the least (the last of equals) of every ``size`` consecutive values."""
    at = np.arange(len(values))
    width, low = 1, values

    def merged(low, at, by, n):
        left, right = low[:n], low[by : by + n]
        return np.minimum(left, right), np.where(right <= left, at[by : by + n], at[:n])

    while 2 * width <= size:
        low, at = merged(low, at, width, len(low) - width)
        width *= 2
    if width < size:
        low, at = merged(low, at, size - width, len(values) - size + 1)
    return at


def occurrences(h: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, reach, first window, windows) of the anchors of texts given by their words' hashes.

    Very many words are taken in blocks; an anchor's row of windows may be cut there, which the word by word extension mends.
    """
    seed = min(SEED, length)
    ends = np.cumsum(counts)
    starts = ends - counts
    out = []
    for low in range(0, max(1, len(h) - length + 1), BLOCK):
        part = h[low : low + BLOCK + length - 1]
        if len(part) < length:
            continue
        grams, windows = run_hashes(part, (seed, length))
        pick = least_of(grams, length - seed + 1)
        text = np.searchsorted(ends, low + np.arange(len(windows)), side="right")
        valid = np.flatnonzero(low + np.arange(len(windows)) + length <= ends[text])
        if not len(valid):
            continue
        chosen = pick[valid]
        new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[valid][1:] != text[valid][:-1])]))
        first, size = valid[new], np.diff(np.append(new, len(valid)))
        last = first + size - 1
        reach = _mixed(windows[first] * MIX + windows[last] * STEP + size.astype(np.uint64))
        of = text[first]
        out.append((of, grams[chosen[new]], reach, low + first - starts[of], size))
    if not out:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# -- repeats --------------------------------------------------------------------------------------------------


def _anchors(length: int):
    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, 2, SLICE_BYTES, SLICE_ROWS):
                of, anchor, reach, first, size = occurrences(*words_of(texts), length)
                ids = [part.column(k).take(pa.array(of)) for k in (0, 1)]
                made = [anchor.view(np.int64), reach.view(np.int64), first.astype(np.int32), size.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, made)], names=["doc", "print", "anchor", "reach", "first", "size"])

    return run


def _windows(length: int):
    """The windows of the ranges (first, size) of each text, by two hashes."""

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, 2, SLICE_BYTES, SLICE_ROWS):
                ranges = part.column(3).to_pylist()
                for i, text in enumerate(texts):
                    h, _ = words_of([text])
                    one, other = run_hashes(h, (length,))[0], run_hashes(h, (length,), MIX)[0]
                    spans = [np.arange(r["first"], r["first"] + r["size"]) for r in ranges[i]]
                    at = np.unique(np.concatenate(spans))
                    for low in range(0, len(at), BLOCK):
                        w = at[low : low + BLOCK]
                        ids = [pa.repeat(part.column(k)[i], len(w)) for k in (0, 1)]
                        made = [one[w].view(np.int64), other[w].view(np.int64), w.astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, made)], names=["doc", "print", "w1", "w2", "first"])

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, print, ranges): for each document, by id and hash of its text, the window ranges (first, size) that repeat.

    The table is stored; what it was made from is removed.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = keyed(docs, id_col, text_col).where("doc is not null and t is not null").select(*KEY, "t")
    found = map_rows(texts, _anchors(length), f"doc {kind}, print long, anchor long, reach long, first int, size int")
    found = stored(found, "anchors")

    seeds = found.groupBy("anchor").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high"),
        (F.min("reach") != F.max("reach")).alias("several"), F.count("*").alias("n"),
    )
    seeds = stored(seeds.where("low < high").select("anchor", "several", "n"), "seeds")
    shared = stored(many_to_one(found, seeds, ["anchor"], "n").drop("n"), "shared")
    discard(found, seeds)

    classes = stored(shared.groupBy("anchor", "reach").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "classes")
    judged = many_to_one(shared, classes, ["anchor", "reach"], "n")
    judged = stored(judged.where("doc > least or several").select(*KEY, "first", "size", (F.col("doc") > F.col("least")).alias("hit")), "judged")
    discard(shared, classes)

    span = F.struct("first", "size")
    left = judged.where("not hit").groupBy(*KEY).agg(F.collect_set(span).alias("ranges"))
    again = texts.join(left, list(KEY)).select(*KEY, "t", "ranges")
    windows = stored(map_rows(again, _windows(length), f"doc {kind}, print long, w1 long, w2 long, first int"), "windows")
    sources = windows.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("high"), F.count("*").alias("n"))
    sources = stored(sources.where("least < high").drop("high"), "sources")
    single = many_to_one(windows, sources, ["w1", "w2"], "n").where("doc > least")
    hits = judged.where("hit").select(*KEY, "first", "size").unionByName(single.select(*KEY, "first", F.lit(1).alias("size")))
    out = stored(hits.groupBy(*KEY).agg(F.collect_set(span).alias("ranges")), "ranges")
    discard(judged, windows, sources)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """k0.. (the kept columns), doc, print and t (the text) of all rows."""
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    return docs.select(*kept, F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("t"))


def without_repeats(
    docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``keep`` columns + n_words, n_removed, removed (ranges of words, end exclusive) and kept (the words that stay,
    joined by one space) of every row."""
    ranges = repeated_ranges(docs, length, id_col, text_col)
    rows = keyed(docs, id_col, text_col, keep).join(ranges, list(KEY), "left")
    names = [f"k{i}" for i in range(len(keep))]
    source = rows.select(*names, "t", "ranges")
    base = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.select(*names).schema)
    at = len(names)
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, at, SLICE_BYTES, SLICE_ROWS):
                made = [_kept(t, r, length) for t, r in zip(texts, part.column(at + 1).to_pylist(), strict=True)]
                n, gone, removed, kept = zip(*made, strict=True)
                columns = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, span), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(at)], *columns], names=[*names, "n_words", "n_removed", "removed", "kept"])

    out = map_rows(source, run, f"{base}n_words long, n_removed long, removed array<struct<first:long,last:long>>, kept string")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_removed", "removed", "kept")


def _kept(text: str | None, ranges: list | None, length: int) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    merged: list[list[int]] = []
    for r in sorted(ranges or [], key=lambda r: r["first"]):
        first, last = r["first"], r["first"] + r["size"] - 1 + length
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    kept, at = [], 0
    for first, last in merged:
        kept += words[at:first]
        at = last
    kept += words[at:]
    return len(words), len(words) - len(kept), [{"first": a, "last": b} for a, b in merged], b" ".join(kept).decode("utf-8", "surrogatepass")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``without_repeats``."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), starts AS (
  SELECT r, doc_id, k, hash(array_to_string(list_slice(w, k, k + 49), ' ')) AS p,
         md5_number(array_to_string(list_slice(w, k, k + 49), ' ')) AS q
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM split WHERE len(w) >= 50 AND doc_id IS NOT NULL)
), sources AS (SELECT p, q, min(doc_id) AS least FROM starts GROUP BY p, q
), hit AS (
  SELECT DISTINCT r, unnest(range(k, k + 50)) AS word_at FROM starts JOIN sources USING (p, q) WHERE doc_id > least
), gone AS (SELECT r, count(*) AS n_removed, list(word_at) AS at FROM hit GROUP BY r
), words AS (
  SELECT s.r, unnest(s.w) AS word, unnest(range(1, len(s.w) + 1)) AS word_at FROM split s JOIN gone USING (r)
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY word_at) AS text FROM words ANTI JOIN hit USING (r, word_at) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(CASE WHEN n_removed IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept.text, '') END) AS kept_sha256
FROM split LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
