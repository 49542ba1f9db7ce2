"""Fill-in-middle transformation of whole texts by content-defined chunks with remembered summaries.

A text is cut into prefix, middle and suffix at two drawn numbers of code points and written with marker strings, prefix
first (``psm``) or suffix first (``spm``); some texts stay ``plain``.  Texts travel as UTF-8, so the numbers of code points
have to be turned into byte places:

1. *Chunks*: a rolling hash over the last ``WINDOW`` bytes cuts a text where the hash has ``MASK`` bits of zero, between
   ``LEAST`` and ``MOST`` bytes apart.  Cuts depend on the content around them alone, so copied passages give equal chunks.
2. *Memory*: a worker keeps the summaries of the chunks that it has seen: code points, whether a marker lies inside, and
   the first and last bytes (a marker may lie across two chunks).  A chunk is found again by its bytes, compared as a
   whole, never by a hash alone.  The memory holds at most ``CACHE_BYTES`` and starts anew beyond; a chunk that is not in it
   is summarised again, so the bound changes no result.
3. *Combination*: summaries add up (counts; last bytes against first bytes for markers), the running counts tell which
   chunk holds a cut, and only that chunk is looked at for the byte place.

Draws are the first four groups of eight hex digits of the SHA-256 of ``seed:id``, so they depend on nothing but the id.

Defined cases: a null text is the empty text, which is plain; texts that contain a marker are plain; a null id draws from
``seed:`` alone; repeated rows give equal rows; an empty table gives no rows; other columns stay if named in ``keep``,
whatever their names.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabshift.llm.common import map_rows, text_slices

MARKERS = ("<P>", "<S>", "<M>")
PLAIN_PERCENT = 10
SPM_PERCENT = 20
WINDOW = 32  # bytes of the rolling hash, a power of two
MASK = np.uint32((1 << 11) - 1)
LEAST, MOST = 512, 16_384
CACHE_BYTES = 32_000_000
BLOCK = 1 << 22
SLICE_BYTES, SLICE_ROWS = 4_000_000, 1_024
FACTOR = 0x01000193
_BYTE = np.arange(1, 257, dtype=np.uint32) * np.uint32(0x9E3779B1)

SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


# -- chunks -----------------------------------------------------------------------------------------------


def _marks(data: np.ndarray) -> np.ndarray:
    """Ends of the windows whose rolling hash has only zeros under ``MASK``."""
    found = []
    for start in range(0, len(data), BLOCK):
        lead = min(start, WINDOW - 1)
        h = _BYTE[data[start - lead : start + BLOCK]]
        width = 1
        while width < WINDOW:  # hash of 2w bytes from those of the w bytes before and the w bytes here
            twice = h.copy()
            twice[width:] += h[:-width] * np.uint32(pow(FACTOR, width, 1 << 32))
            h, width = twice, 2 * width
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        at = np.flatnonzero((h >> np.uint32(13)) & MASK == 0)
        found.append(at[at >= lead] + (start - lead + 1))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(marks: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of the bytes from ``start`` to ``end``, given the marks of the buffer around them."""
    ends, at, k = [], start, bisect.bisect_left(marks, start + LEAST)
    while end - at > LEAST:
        k = bisect.bisect_left(marks, at + LEAST, k)
        at = min(marks[k] if k < len(marks) else end, at + MOST, end)
        ends.append(at)
    if at < end:
        ends.append(end)
    return ends


# -- summaries ---------------------------------------------------------------------------------------------


def _leads(chunk: bytes) -> np.ndarray:
    """Places of the bytes that begin a code point."""
    return np.flatnonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80)


class Summaries:
    """Summaries (code points, holds a marker, first bytes, last bytes) of chunks, remembered by content."""

    def __init__(self, markers: tuple[str, ...], most_bytes: int = CACHE_BYTES):
        self.markers = [m.encode() for m in markers]
        self.edge = max(map(len, self.markers)) - 1
        self.most = most_bytes
        self.known: dict[bytes, tuple] = {}
        self.held = self.hits = self.misses = 0

    def marked(self, data: bytes) -> bool:
        return any(m in data for m in self.markers)

    def of(self, chunk: bytes) -> tuple:
        got = self.known.get(chunk)
        if got is not None:
            self.hits += 1
            return got
        self.misses += 1
        chars = len(chunk) if chunk.isascii() else len(_leads(chunk))
        got = (chars, self.marked(chunk), chunk[: self.edge], chunk[len(chunk) - self.edge if len(chunk) > self.edge else 0 :])
        if self.held + len(chunk) > self.most:
            self.known.clear()
            self.held = 0
        self.known[chunk] = got
        self.held += len(chunk)
        return got

    def combined(self, chunks: list[bytes]) -> tuple[list[int], bool]:
        """(running code points, whether a marker occurs, also across chunks) of consecutive chunks."""
        counts, marked, tail = [], False, b""
        for chunk in chunks:
            chars, inside, head, last = self.of(chunk)
            marked = marked or inside or self.marked(tail + head)
            whole = last if len(chunk) >= self.edge else tail + chunk
            tail = whole[max(0, len(whole) - self.edge) :]
            counts.append(chars)
        return list(itertools.accumulate(counts)), marked


def byte_place(chunks: list[bytes], upto: list[int], chars: int) -> int:
    """Where the first ``chars`` code points end, in bytes."""
    k = bisect.bisect_right(upto, chars)
    before = sum(map(len, chunks[:k]))
    if k == len(chunks):
        return before
    inside = chars - (upto[k - 1] if k else 0)
    n = upto[k] - (upto[k - 1] if k else 0)
    return before + (inside if n == len(chunks[k]) else int(_leads(chunks[k])[inside]))


# -- transformation -----------------------------------------------------------------------------------------


def draws(id_col: str, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:id``."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(summaries: Summaries, markers, raw: bytes, chunks: list[bytes], h, plain_percent, spm_percent) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    upto, marked = summaries.combined(chunks)
    n = upto[-1] if upto else 0
    if not raw or marked or h[2] % 100 >= 100 - plain_percent:
        return n, "plain", None, None, raw
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = byte_place(chunks, upto, first), byte_place(chunks, upto, last)
    p, s, m = markers
    if h[3] % 100 < spm_percent:
        return n, "spm", first, last - first, b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
    return n, "psm", first, last - first, b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))


def fill_in_middle(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    markers: tuple[str, str, str] = MARKERS,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
    cache_bytes: int = CACHE_BYTES,
) -> DataFrame:
    """``keep`` columns + n, form, prefix_chars, middle_chars (null where plain) and output, for every row."""
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *draws(id_col, seed), F.col(text_col).alias("t"))
    names = [f"k{i}" for i in range(len(keep))]
    base = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.select(*names).schema)
    at = len(names) + 4
    marks_of = tuple(m.encode() for m in markers)

    def run(batches):
        summaries = Summaries(markers, cache_bytes)
        for batch in batches:
            for part, texts in text_slices(batch, at, SLICE_BYTES, SLICE_ROWS):
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
                marks = _marks(np.frombuffer(b"".join(raws), np.uint8)).tolist()
                hashes = zip(*[part.column(len(names) + k).to_pylist() for k in range(4)], strict=True)
                rows, start = [], 0
                for raw, h in zip(raws, hashes, strict=True):
                    ends = chunk_ends(marks, start, start + len(raw))
                    cuts = [0, *[e - start for e in ends]]
                    chunks = [raw[x:y] for x, y in itertools.pairwise(cuts)]
                    rows.append(transform(summaries, marks_of, raw, chunks, h, plain_percent, spm_percent))
                    start += len(raw)
                n, form, prefix, middle, output = zip(*rows, strict=True)
                made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                columns = [part.column(k) for k in range(len(names))] + made
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n", "form", "prefix_chars", "middle_chars", "output"])

    out = map_rows(source, run, base + SCHEMA)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made from, by DataFrame functions (no marker occurs in a text that was cut)."""
    p, s, m = markers

    def between(text: Column, start: Column, end: Column) -> Column:
        return text.substr(start, F.greatest(end - start, F.lit(0)))

    end = F.length(output) + 1
    second = F.when(form == "psm", F.locate(s, output)).otherwise(F.locate(p, output))
    third = F.locate(m, output)
    one = between(output, F.lit(len(p) + 1), second)
    spm_one = between(output, F.lit(len(s) + 1), second)
    middle = between(output, third + len(m), end)
    psm = F.concat(one, middle, between(output, second + len(s), third))
    spm = F.concat(between(output, second + len(p), third), middle, spm_one)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``fill_in_middle``."""
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        _sha256(F.col("output")).alias("output_sha256"),
        _sha256(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), numbers AS (
  SELECT doc_id, t, length(t) AS n,
    CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM drawn
), cut AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
