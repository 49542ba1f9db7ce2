"""N-gram Jaccard join of documents by a grouped prefix join, and the components of its links.

A document's set holds its distinct word shingles (64-bit hashes); two documents link when
``100 * intersection >= 80 * union``.  Sets that link must share a shingle among the first ``n - ceil(0.8 n) + 1`` of
each, under any one order of all shingles.

1. *Order*: shingles that occur repeatedly are counted over all documents (whatever occurs at least twice in a chunk of
   documents); the most frequent ``FREQUENT`` come last, by count, all others by hash.  The order only decides how
   much work there is, never which links are found.
2. *Groups*: documents with equal sets become one node; nodes with identical prefixes and size become one group, which
   is indexed once, and whose filter results hold for all members.
3. *First candidates*: each shingle's list of groups is ordered by size.  Short lists give all their pairs; in a long one
   groups meet a centre, the smallest group within the size ratio.  A list of near copies so costs its length, not
   its square.  Size and position filters apply.  Members of a group meet the group's first.
4. *Verification* of candidates, first by how many shingles their prefixes share, which bounds the intersection from
   above, then by the intersections of their sets; components of the links.  Sets travel once to each
   centre with 32 bits a shingle; pairs so near the threshold that chance matches of 32 bits could decide are verified
   again with 64.
5. *Tries*: in the long lists every group that is not yet in one component with all others tries two more: the
   one with most links so far, and a random one.  In a family of near copies whose pairs link now and then this finds
   the copies nearest to the origin and joins nearly all, at a cost in proportion to its size.
6. *Remaining candidates*: in the long lists all groups that are still not in one component meet (again filtered); they, and
   the first candidates' groups of several members, are expanded to their members, and verified.  Pairs inside a component need no check: a link there changes nothing.

Sets are recomputed from the text for the candidates only.  The links found are enough to connect every two documents
that a chain of links connects, and no others.

Defined cases: null, empty or wordless texts have no shingle and are their own component; a text with fewer than five
words has its whole word sequence as its one shingle; a null id has a null component and links with nothing; an id
should name one text: rows that repeat an id with another text are placed each by its own text; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabshift.llm.common import discard, give_back, map_rows, release, stored, text_slices
from vocabshift.llm.components import components
from vocabshift.llm.shingles import shingle_sets

SIZE = 5
PERCENT = 80
FREQUENT = 1 << 18
CHUNK = 1 << 21
POSTINGS_AT_ONCE = 1 << 19
TOKENS_PER_BUCKET = 1_000_000
LEAST_BUCKETS = 32
SHORT_LIST = 4
TRIES = 1
ENOUGH = 20  # rounds of tries end when fewer than one in so many links
SLICE_BYTES, SLICE_ROWS = 600_000, 512
FILTER_BITS = 1 << 20
PAIRS_AT_ONCE = 1 << 22
PARTNERS = 32
TOKEN_BYTES = 6
MARK_BITS = 1024  # of a set's bit mark
MARKS_AT_ONCE = 1 << 17
COUNT_STEPS = 8  # counts of shingles are told apart by eighths of a doubling
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # odd: a product's upper bits hang on all bits of a token
FAR = 0xFFFF  # a place in a prefix that is not told exactly
POSTING = np.dtype([("token", "<u4"), ("gid", "<i8"), ("n", "<i4"), ("pos", "<u2")])
LABELLED = np.dtype([*POSTING.descr, ("label", "<i8"), ("links", "<i8")])


def prefix_size(n: int) -> int:
    """How many first shingles of a set of ``n`` decide whether it can link."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def _sets(batch: pa.RecordBatch, at: int):
    for _, texts in text_slices(batch, at, SLICE_BYTES, SLICE_ROWS):
        yield from shingle_sets(texts, SIZE)


# -- order ------------------------------------------------------------------------------------------------


def _repeated(batches):
    """(token, documents) of the shingles that occur in at least two documents of a chunk; equal sets count once."""
    held, size, seen = [], 0, set()

    def flush():
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], ["token", "documents"]
        )

    for batch in batches:
        for s in _sets(batch, 0):
            mark = _fingerprint(s)
            if mark in seen:
                continue
            seen.add(mark)
            held.append(s)
            size += len(s)
            if size >= CHUNK:
                yield flush()
                held, size, seen = [], 0, set()
    if held:
        yield flush()


def frequent_shingles(documents: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(ascending hashes, rank by count) of the most frequent shingles of the corpus, ``most`` at most.

    A histogram of the counts tells from which count on the shingles are few enough; only those come to the driver.
    """
    counted = map_rows(documents.select("text"), _repeated, "token long, documents long")
    total = stored(counted.groupBy("token").agg(F.sum("documents").alias("documents")), "counts")
    step = F.floor(F.log2("documents") * COUNT_STEPS).cast("int")
    steps = total.groupBy(step.alias("step")).agg(F.count("*").alias("tokens")).collect()  # at most 64 doublings
    held, least = 0, None
    for step_, tokens in sorted(((r["step"], r["tokens"]) for r in steps), reverse=True):
        if held + tokens > most:
            break
        held, least = held + tokens, step_
    top = total.where(step >= F.lit(least)).toArrow() if least is not None else pa.table({"token": pa.array([], pa.int64()), "documents": pa.array([], pa.int64())})
    discard(total)
    tokens = top["token"].to_numpy().view(np.uint64)
    documents_ = top["documents"].to_numpy()
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -documents_))] = np.arange(len(tokens), 0, -1)  # rarest of them first
    order = np.argsort(tokens)
    return tokens[order], rank[order]


def in_order(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """An ascending set in the common order."""
    if not len(frequent) or not len(s):
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    late = frequent[at] == s
    if not late.any():
        return s
    last = s[late]
    return np.concatenate([s[~late], last[np.argsort(rank[at[late]], kind="stable")]])


# -- features ---------------------------------------------------------------------------------------------


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums of a set."""
    with np.errstate(over="ignore"):
        other = (s ^ (s >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        other ^= other >> np.uint64(27)
        return int(s.sum(dtype=np.uint64).view(np.int64)), int((other * other).sum(dtype=np.uint64).view(np.int64))


def _mark(s: np.ndarray) -> bytes:
    """The bits that a set's shingles set in a mark of ``MARK_BITS``."""
    bits = np.zeros(MARK_BITS, bool)
    bits[(s >> np.uint64(20)) % np.uint64(MARK_BITS)] = True
    return np.packbits(bits).tobytes()


def features(documents: DataFrame, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """doc_id, n, f1, f2 (set fingerprint), p1, p2 (prefix fingerprint), late, prefix (top 48 bits of the hashes, in order), mark.

    ``late``: 1 if the prefix ends in a frequent shingle.  ``mark``: the bits of all shingles of the set.
    """
    shared = documents.sparkSession.sparkContext.broadcast((frequent, rank))

    def run(batches):
        tokens, ranks = shared.value
        for batch in batches:
            rows, prefixes, marks = [], [], []
            for s in _sets(batch, 1):
                prefix = in_order(s, tokens, ranks)[: prefix_size(len(s))]
                late = int(len(prefix) > 0 and len(tokens) > 0 and tokens[min(np.searchsorted(tokens, prefix[-1]), len(tokens) - 1)] == prefix[-1])
                rows.append((len(s), *_fingerprint(s), *_fingerprint(prefix), late))
                top = np.ascontiguousarray(prefix >> np.uint64(16))
                prefixes.append(top.view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes())
                marks.append(_mark(s))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in cols], pa.array(prefixes, pa.binary()), pa.array(marks, pa.binary())],
                ["doc_id", "n", "f1", "f2", "p1", "p2", "late", "prefix", "mark"],
            )

    return map_rows(
        documents.select(F.col("doc_id").cast("long"), "text"),
        run,
        "doc_id long, n long, f1 long, f2 long, p1 long, p2 long, late long, prefix binary, mark binary",
    )


# -- candidates -------------------------------------------------------------------------------------------


def _tokens(prefix: bytes) -> np.ndarray:
    """The 48-bit tokens of a stored prefix."""
    out = np.zeros((len(prefix) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(prefix, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view(np.uint64)[:, 0]


def packed(p: np.ndarray) -> bytes:
    """Postings of one bucket, those of a group together, column by column; groups that share a gid differ in size."""
    new = np.append(True, (p["gid"][1:] != p["gid"][:-1]) | (p["n"][1:] != p["n"][:-1]))
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(p))).astype("<i4")
    head = np.array([len(first), len(p)], "<i4")
    columns = [head, p["gid"][first], p["n"][first], counts, p["token"], p["pos"]]
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpacked(raw: bytes) -> np.ndarray:
    """The postings that ``packed`` wrote."""
    groups, size = np.frombuffer(raw, "<i4", 2).tolist()
    at, columns = 8, []
    for kind, n in (("<i8", groups), ("<i4", groups), ("<i4", groups), ("<u4", size), ("<u2", size)):
        columns.append(np.frombuffer(raw, kind, n, at))
        at += columns[-1].nbytes
    gid, n, counts, token, pos = columns
    p = np.zeros(size, POSTING)
    p["gid"], p["n"] = np.repeat(gid, counts), np.repeat(n, counts)
    p["token"], p["pos"] = token, pos
    return p


def _postings(buckets: int):
    """Partition function: groups (gid, n, prefix) to packed postings per hash bucket."""

    def run(batches):
        held, size = [], 0

        def flush():
            tokens = np.concatenate([t for _, _, t in held])
            lengths = [len(t) for _, _, t in held]
            every = np.zeros(len(tokens), POSTING)
            every["token"] = tokens & np.uint64(0xFFFFFFFF)
            every["gid"] = np.repeat([g for g, _, _ in held], lengths)
            every["n"] = np.repeat([n for _, n, _ in held], lengths)
            every["pos"] = np.concatenate([np.minimum(np.arange(k), FAR) for k in lengths])
            bucket = ((tokens * SPREAD >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, every = bucket[order], every[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            parts = [packed(x) for x in np.split(every, cuts[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[cuts]), pa.array(parts, pa.binary())], ["bucket", "postings"]
            )

        for batch in batches:
            for gid, n, prefix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((gid, n, _tokens(prefix)))
                size += len(held[-1][2])
                if size >= POSTINGS_AT_ONCE:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def can_link(n_a, pos_a, n_b, pos_b):
    """Size and position filters: whether two sets whose *first* common shingle is at these places can link.

    From their first common shingle on, both must have as many shingles left as a link needs in common.  Every pair
    that links passes at its first common shingle, so a list may leave out the pairs that fail there.
    """
    n_a, n_b, pos_a, pos_b = (x.astype(np.int64) for x in (n_a, n_b, pos_a, pos_b))
    most = np.minimum(n_a - np.where(pos_a == FAR, 0, pos_a), n_b - np.where(pos_b == FAR, 0, pos_b))
    ratio = np.minimum(n_a, n_b) * 100 >= PERCENT * np.maximum(n_a, n_b)
    return ratio & (most * (100 + PERCENT) >= PERCENT * (n_a + n_b))


def may_link(n_a, pos_a, n_b, pos_b):
    """The same for sets that have a common shingle at these places, first or not."""
    n_a, n_b, pos_a, pos_b = (x.astype(np.int64) for x in (n_a, n_b, pos_a, pos_b))
    most = np.minimum(pos_a, pos_b) + np.minimum(n_a - pos_a, n_b - pos_b)
    ratio = np.minimum(n_a, n_b) * 100 >= PERCENT * np.maximum(n_a, n_b)
    near = most * (100 + PERCENT) >= PERCENT * (n_a + n_b)
    return ratio & (near | (pos_a == FAR) | (pos_b == FAR))


def _runs(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings by (token, n, gid) without the shingles of one group only, and start and length of each list."""
    p = p[np.lexsort((p["gid"], p["n"], p["token"]))]
    new = np.append(True, p["token"][1:] != p["token"][:-1])
    lengths = np.diff(np.append(np.flatnonzero(new), len(p)))
    p = p[np.repeat(lengths, lengths) > 1]
    lengths = lengths[lengths > 1]
    return p, np.cumsum(lengths) - lengths, lengths


def _pairs_frame(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    low, high = np.minimum(a, b), np.maximum(a, b)
    return pd.DataFrame({"a": low, "b": high}).drop_duplicates()


def first_pairs(p: np.ndarray) -> pd.DataFrame:
    """All pairs of short lists, (centre, other) pairs of long ones; pairs pass the filters."""
    p, start, length = _runs(p)
    if not len(p):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    left, right = [], []
    for d in range(1, SHORT_LIST):
        # neighbours at distance d in a short list
        for o in range(SHORT_LIST - d):
            on = start[(length <= SHORT_LIST) & (length > o + d)]
            left.append(on + o)
            right.append(on + o + d)
    long = length > SHORT_LIST
    centre = np.repeat(start[long], length[long])
    other = np.arange(len(p))[np.repeat(long, length)]
    n = p["n"].astype(np.int64)
    while len(other):
        # those beyond the size ratio of their centre get the first of them as the next centre
        beyond = n[other] * PERCENT > n[centre] * 100
        left.append(centre[~beyond])
        right.append(other[~beyond])
        centre, other = centre[beyond], other[beyond]
        if len(other):
            first = np.append(True, centre[1:] != centre[:-1])
            centre = np.repeat(other[first], np.diff(np.append(np.flatnonzero(first), len(other))))
    a, b = np.concatenate(left), np.concatenate(right)
    places = (p["n"][a], p["pos"][a], p["n"][b], p["pos"][b])
    in_short = ~long[np.searchsorted(start, a, side="right") - 1]
    ok = (a != b) & np.where(in_short, can_link(*places), may_link(*places))
    return _pairs_frame(p["gid"][a[ok]], p["gid"][b[ok]])


def tried_pairs(p: np.ndarray, turn: int) -> pd.DataFrame:
    """(a, b, links): partners of another label for the groups of every list.

    ``links`` is the number of links so far of the list's most linked group, if that is the partner, and -1 for a random
    neighbour (of an order that changes with ``turn``).
    """
    dice = (p["gid"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)) ^ p["token"].astype(np.uint64)
    dice = (dice ^ (dice >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    out = []
    for order in (np.lexsort((dice, -p["links"], p["token"])), np.lexsort((dice, p["token"]))):
        q = p[order]
        first = np.append(True, q["token"][1:] != q["token"][:-1])
        start = np.flatnonzero(first)
        if not out:
            b = np.repeat(start, np.diff(np.append(start, len(q))))
            weight = q["links"][b]
        else:
            b = np.maximum(np.arange(len(q)) - 1, 0)
            weight = np.full(len(q), -1)
        a = np.arange(len(q))
        ok = (q["token"][a] == q["token"][b]) & (q["label"][a] != q["label"][b]) & (q["gid"][a] != q["gid"][b])
        ok &= may_link(q["n"][a], q["pos"][a], q["n"][b], q["pos"][b])
        out.append(pd.DataFrame({"a": q["gid"][a[ok]], "b": q["gid"][b[ok]], "links": weight[ok].astype(np.int64)}))
    return pd.concat(out).drop_duplicates()


def long_lists(p: np.ndarray) -> np.ndarray:
    """The postings of the long lists."""
    p, _, length = _runs(p)
    return p[np.repeat(length, length) > SHORT_LIST]


def first_candidates(postings: DataFrame) -> DataFrame:
    """Candidate pairs of groups (kind 'pair': a, b) and the long lists (kind 'list': bucket, postings)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        p = np.concatenate([unpacked(raw) for raw in frame["postings"]])
        pairs, rest = first_pairs(p), long_lists(p)
        pairs["bucket"], pairs["postings"] = frame["bucket"].iloc[0], None
        if len(rest):
            rest = packed(rest[np.argsort(rest["gid"], kind="stable")])
            pairs.loc[len(pairs) + len(p)] = [0, 0, frame["bucket"].iloc[0], rest]
        give_back()
        return pairs[["a", "b", "bucket", "postings"]]

    return postings.groupBy("bucket").applyInPandas(run, "a long, b long, bucket int, postings binary")


def near_by_marks(marks: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets with these marks (all bits: not known) can link.

    A bit that only one of two marks has stands for at least one shingle that the other set lacks.
    """
    keep = np.zeros(len(a), bool)
    for i in range(0, len(a), MARKS_AT_ONCE):
        x, y = a[i : i + MARKS_AT_ONCE], b[i : i + MARKS_AT_ONCE]
        mx, my = marks[x], marks[y]
        known = ~((mx == FULL).all(axis=1) | (my == FULL).all(axis=1))
        lack_x = np.where(known, np.bitwise_count(mx & ~my).sum(axis=1, dtype=np.int64), 0)
        lack_y = np.where(known, np.bitwise_count(my & ~mx).sum(axis=1, dtype=np.int64), 0)
        nx, ny = n[x].astype(np.int64), n[y].astype(np.int64)
        most = np.minimum(nx - lack_x, ny - lack_y)
        keep[i : i + MARKS_AT_ONCE] = most * (100 + PERCENT) >= PERCENT * (nx + ny)
    return keep


FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
NO_MARK = b"\xff" * (MARK_BITS // 8)


def met_before(x: dict, n_x: int, y: dict, n_y: int) -> bool:
    """Whether two sets pass the position filter of ``can_link`` in one of the lists (places by list) that both are in."""
    least = -(-PERCENT * (n_x + n_y) // (100 + PERCENT))
    left = lambda n, pos: n - (0 if pos == FAR else pos)
    return any(left(n_x, x[k]) >= least and left(n_y, y[k]) >= least for k in x.keys() & y.keys())


def second_pairs(p: np.ndarray, marks: np.ndarray | None = None, before: list | None = None) -> pd.DataFrame:
    """Pairs of one list whose labels differ (label -1: a group with several), which pass the filters.

    Members of a list's most common label are not compared with each other.  Sets are compared by places and marks here, so
    only pairs that are likely to link become rows.  ``before``: the group's places in the lists that hold it at an earlier
    place; a pair becomes a row at the first common shingle where it passes, not once a bucket.
    """
    order = np.lexsort((p["gid"], p["n"], p["token"]))
    p, marks = p[order], None if marks is None else marks[order]
    before = None if before is None else [before[i] for i in order]
    new = np.append(True, p["token"][1:] != p["token"][:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(p)))
    out = []
    for s, k in zip(start.tolist(), length.tolist(), strict=True):
        run = p[s : s + k]
        labels, inverse, counts = np.unique(run["label"], return_inverse=True, return_counts=True)
        if len(labels) == 1 and labels[0] != -1:
            continue
        counts[labels == -1] = 0
        odd = np.flatnonzero(inverse != counts.argmax()) if counts.max() else np.arange(k)
        step = max(1, PAIRS_AT_ONCE // k)
        for i in range(0, len(odd), step):
            a = np.repeat(odd[i : i + step], k)
            b = np.tile(np.arange(k), len(odd[i : i + step]))
            differ = (run["label"][a] != run["label"][b]) | (run["label"][a] == -1)
            a, b = a[differ & (a != b)], b[differ & (a != b)]
            ok = can_link(run["n"][a], run["pos"][a], run["n"][b], run["pos"][b])
            a, b = a[ok], b[ok]
            ok = slice(None) if marks is None else near_by_marks(marks[s : s + k], run["n"], a, b)
            a, b = a[ok], b[ok]
            if before is not None:
                sizes = run["n"].tolist()
                pairs = zip(a.tolist(), b.tolist(), strict=True)
                new = np.array([not met_before(before[s + x], sizes[x], before[s + y], sizes[y]) for x, y in pairs], bool)
                a, b = a[new], b[new]
            out.append(_pairs_frame(run["gid"][a], run["gid"][b]))
    if not out:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    return pd.concat(out).drop_duplicates()


def long_rows(lists: DataFrame) -> DataFrame:
    """The postings of the long lists as rows: bucket, token, gid, n, pos."""

    def explode(batches):
        for batch in batches:
            for bucket, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = unpacked(raw)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(p), bucket, np.int32)),
                        pa.array(p["token"].astype(np.int64)),
                        pa.array(p["gid"].copy()),
                        pa.array(p["n"].copy()),
                        pa.array(p["pos"].astype(np.int32)),
                    ],
                    ["bucket", "token", "gid", "n", "pos"],
                )

    return map_rows(lists, explode, "bucket int, token long, gid long, n int, pos int")


def live_rows(rows: DataFrame, group_labels: DataFrame) -> DataFrame:
    """The rows, with labels, of the lists that hold several labels."""
    labelled = rows.join(group_labels, "gid", "left").withColumn("label", F.coalesce("label", "gid"))
    list_key = ["bucket", "token"]
    mixed = labelled.groupBy(*list_key).agg(F.min("label").alias("l"), F.max("label").alias("h"))
    return labelled.join(mixed.where("l <> h or l = -1").select(*list_key), list_key, "left_semi")


def _pairs_of(live: DataFrame, pairs, schema: str) -> DataFrame:
    """Pairs by a function of a bucket's labelled postings."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        p = np.zeros(len(frame), LABELLED)
        for c in ("token", "gid", "n", "pos", "label", "links"):
            if c in frame:
                p[c] = frame[c].to_numpy()
        if "mark" not in frame:
            return pairs(p)
        raw = b"".join(NO_MARK if m is None else m for m in frame["mark"])
        own = zip(frame["before"], frame["places"], strict=True)
        before = [{} if x is None else dict(zip(x.tolist(), y.tolist(), strict=True)) for x, y in own]
        return pairs(p, np.frombuffer(raw, np.uint64).reshape(len(p), -1), before)

    return live.groupBy("bucket").applyInPandas(run, schema)


def tried_candidates(live: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """At most two pairs a group to try: with the most linked and with a random other group of its lists."""
    ends = links.select(F.col("a").alias("gid")).union(links.select(F.col("b").alias("gid"))).groupBy("gid").agg(F.count("*").alias("links"))
    rated = live.join(ends, "gid", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    pairs = _pairs_of(rated, lambda p: tried_pairs(p, turn), "a long, b long, links long")
    known = F.struct("links", F.xxhash64("a", "b", F.lit(turn)).alias("d"), "b")
    best = pairs.groupBy("a").agg(F.max(known).alias("p"), F.min(known).alias("q"))
    chosen = best.select("a", F.explode(F.array("p.b", "q.b")).alias("b"))
    return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def second_candidates(live: DataFrame, members: DataFrame, feats: DataFrame) -> DataFrame:
    """Candidate pairs of groups that are still apart, from the long lists.

    Groups of one member, whose id names one set, are compared by marks too, and pairs of them become rows once: a pair that
    links and has not met in a short list meets in the list of its first common shingle, which is live.
    """
    single = members.groupBy("gid").agg(F.count("*").alias("nodes")).where("nodes = 1").select("gid")
    wanted = live.select("gid").distinct().join(single, "gid", "left_semi")
    sets = feats.where("n > 0").select(F.col("doc_id").alias("gid"), F.struct("mark", "n", "f1", "f2").alias("set"))
    one = sets.join(wanted, "gid", "left_semi").groupBy("gid").agg(F.min("set").alias("set"), F.max("set").alias("other"))
    one = one.where("set = other").select("gid", "set.mark")
    place = F.struct((F.shiftleft(F.col("bucket").cast("long"), 32) + F.col("token")).alias("list"), "pos")
    own = one.join(live.groupBy("gid").agg(F.collect_list(place).alias("lists")), "gid")
    earlier = F.filter("lists", lambda x: x["pos"] < F.col("pos"))
    met = live.join(own, "gid", "left").select(*live.columns, "mark", earlier["list"].alias("before"), earlier["pos"].alias("places"))
    return _pairs_of(met, second_pairs, "a long, b long").distinct()


def member_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The first candidates of which a group has several members: only the groups' first ones have met."""
    several = members.groupBy("gid").agg(F.count("*").alias("nodes")).where("nodes > 1")
    of = lambda x: pairs.join(several.select(F.col("gid").alias(x)), x, "left_semi").select("a", "b")
    return of("a").union(of("b")).distinct()


# -- verification -----------------------------------------------------------------------------------------


def _nodes_filter(pairs: DataFrame):
    """(bit expression of ``doc_id``, shared flags): a filter of bounded size for the documents in pairs."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("int")
    flags = np.zeros(FILTER_BITS, bool)
    flags[ids.select(bit.alias("bit")).distinct().toPandas()["bit"].to_numpy()] = True
    return bit, pairs.sparkSession.sparkContext.broadcast(np.packbits(flags))


def most_common(x: np.ndarray, n_x: int, late_x: int, y: np.ndarray, n_y: int, late_y: int) -> int:
    """The largest intersection that two sets can have, by their prefixes (tokens in the common order).

    The prefix that ends first in the order has all its matches inside the other prefix; beyond its end, the other
    set has only so many shingles left.
    """
    c = len(np.intersect1d(x, y))
    rest_x, rest_y = n_x - len(x), n_y - len(y)
    if late_x and late_y:
        return c + max(rest_x, rest_y)
    if late_y or (not late_x and x[-1] <= y[-1]):
        before = len(y) if late_y else int(np.searchsorted(y, x[-1], side="right"))
        return c + min(rest_x, n_y - (before if not late_y else 0))
    before = len(x) if late_x else int(np.searchsorted(x, y[-1], side="right"))
    return c + min(rest_y, n_x - (before if not late_x else 0))


def plausible(feats: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose prefixes share enough for a link."""
    bit, shared = _nodes_filter(pairs)

    def wanted(batches):
        flags = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            keep = pa.array(flags[batch.column(4).to_numpy(zero_copy_only=False)])
            yield batch.select([0, 1, 2, 3]).filter(keep)

    source = feats.where("doc_id is not null and n > 0").select("doc_id", "n", "late", "prefix", bit.alias("bit"))
    own = map_rows(source, wanted, "doc_id long, n long, late long, prefix binary")
    side = lambda x: own.select(
        F.col("doc_id").alias(x), F.struct("n", "late", "prefix").alias(f"p{x}")
    )

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                most = most_common(
                    _tokens(x["prefix"]), x["n"], x["late"], _tokens(y["prefix"]), y["n"], y["late"]
                )
                keep.append(most * (100 + PERCENT) >= PERCENT * (x["n"] + y["n"]))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "pa", "pb")
    return map_rows(met, run, "a long, b long").distinct()


def _candidate_sets(documents: DataFrame, pairs: DataFrame, bits: int) -> DataFrame:
    """(doc_id, n, shingles of ``bits`` bits) of at least the documents in pairs.

    A bit filter of bounded size spares most other documents the hashing.
    """
    bit, shared = _nodes_filter(pairs)

    def run(batches):
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            some = batch.filter(pa.array(wanted[batch.column(2).to_numpy(zero_copy_only=False)]))
            for part, texts in text_slices(some, 1, SLICE_BYTES, SLICE_ROWS):
                sets = shingle_sets(texts, SIZE)
                kept = [np.unique(s >> np.uint64(32)).astype("<u4") if bits == 32 else s for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([s.tobytes() for s in kept], pa.binary()),
                    ],
                    ["doc_id", "n", "shingles"],
                )

    known = documents.where("doc_id is not null and text is not null")
    source = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("bit", bit)
    return map_rows(source, run, "doc_id long, n long, shingles binary")


def decide(n_a: int, n_b: int, common: int, bits: int) -> int:
    """1: links, 0: does not, 2: chance matches of ``bits`` bits could decide (never with 64)."""
    spare = 0 if bits == 64 else 3 + 64 * n_a * n_b // (1 << bits)
    if (common - spare) * (100 + PERCENT) >= PERCENT * (n_a + n_b):
        return 1
    return 2 if (common + spare) * (100 + PERCENT) >= PERCENT * (n_a + n_b) else 0


def _decided(documents: DataFrame, pairs: DataFrame, bits: int) -> DataFrame:
    """(a, b, decision) of pairs: the sets of a centre's partners meet the centre's set, ``PARTNERS`` at a time.

    The end with more pairs is the centre, so a hub's set travels once for every ``PARTNERS`` pairs of its own.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).groupBy("node").count()
    of = lambda x: ends.select(F.col("node").alias(x), F.col("count").alias(f"n{x}"))
    graded = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    first = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    centre, other = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    salts = F.ceil(F.greatest("na", "nb") / F.lit(PARTNERS)).cast("long")
    routed = graded.select(
        centre.alias("centre"), other.alias("doc_id"), F.pmod(F.xxhash64(other), salts).alias("salt"), F.lit(1).alias("role")
    )
    centres = routed.select("centre", F.col("centre").alias("doc_id"), "salt", F.lit(0).alias("role")).distinct()
    sets = _candidate_sets(documents, pairs, bits)
    met = sets.join(routed.unionByName(centres), "doc_id").select("centre", "salt", "role", "doc_id", "n", "shingles")
    met = met.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")
    kind = np.dtype("<u4") if bits == 32 else np.dtype("<u8")

    def run(batches):
        held: dict = {"key": None, "sets": []}
        for batch in batches:
            out = []
            for key, salt, role, doc, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, kind)
                if (key, salt) != held["key"]:
                    held = {"key": (key, salt), "sets": []}
                if role == 0:
                    held["sets"].append((n, own))
                    continue
                for m, s in held["sets"]:
                    common = len(np.intersect1d(own, s, assume_unique=True))
                    out.append((min(key, doc), max(key, doc), decide(n, m, common, bits)))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            kinds = [pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["a", "b", "d"])

    return map_rows(met, run, "a long, b long, d int")


def verified(documents: DataFrame, feats: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The candidate pairs (a, b) that link, stored."""
    pairs = stored(plausible(feats, pairs), f"plausible-{name}")
    coarse = stored(_decided(documents, pairs, 32).where("d > 0"), f"decided-{name}")
    sure = coarse.where("d = 1").select("a", "b")
    near = coarse.where("d = 2").select("a", "b").join(sure, ["a", "b"], "left_anti").distinct()
    near = stored(near, f"near-{name}")
    if near.limit(1).count():
        sure = sure.union(_decided(documents, near, 64).where("d = 1").select("a", "b"))
    found = stored(sure.distinct(), f"links-{name}")
    discard(pairs, coarse, near)
    return found


# -- operator ---------------------------------------------------------------------------------------------


def _labels(members: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gid, node, label) of all members and (gid, label) of all groups; a group with several labels has -1."""
    found = members.join(known.withColumnRenamed("component", "label"), "node", "left")
    label = stored(found.select("gid", "node", F.coalesce("label", "node").alias("label")), "labels")
    ends = label.groupBy("gid").agg(F.min("label").alias("l"), F.max("label").alias("h"))
    return label, ends.select("gid", F.when(F.col("l") == F.col("h"), F.col("l")).otherwise(-1).alias("label"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    frequent, rank = frequent_shingles(documents)
    feats = stored(features(documents, frequent, rank), "features")
    linkable = feats.where("n > 0 and doc_id is not null")
    nodes = stored(linkable.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("node")), "nodes")
    groups = stored(linkable.groupBy("n", "p1", "p2").agg(F.min("doc_id").alias("gid")), "groups")
    keyed = linkable.select("doc_id", "n", "f1", "f2", "p1", "p2")
    own = keyed.join(nodes.withColumnRenamed("node", "doc_id"), ["doc_id", "n", "f1", "f2"], "left_semi")
    members = own.join(groups, ["n", "p1", "p2"]).select("gid", F.col("doc_id").alias("node")).distinct()
    members = stored(members, "members")
    total = linkable.agg(F.sum(F.length("prefix")).alias("bytes")).first()["bytes"] or 0
    buckets = max(LEAST_BUCKETS, total // (TOKEN_BYTES * TOKENS_PER_BUCKET))
    ids = groups.select("n", "p1", "p2", F.col("gid").alias("doc_id"))
    chosen = linkable.select("doc_id", "n", "p1", "p2", "prefix").join(ids, ["doc_id", "n", "p1", "p2"], "left_semi")
    posted = map_rows(chosen.select("doc_id", "n", "prefix"), _postings(buckets), "bucket int, postings binary")
    first = stored(first_candidates(posted), "first")
    inside = members.where("gid <> node").select(F.col("gid").alias("a"), F.col("node").alias("b"))
    pairs = stored(
        first.where("postings is null").select("a", "b").union(inside).distinct(), "pairs-1"
    )
    links = verified(documents, feats, pairs, "1")
    release(documents.sparkSession)
    known = components(links)

    rows = long_rows(first.where("postings is not null").select("bucket", "postings"))
    label, group_label = _labels(members, known)
    live = stored(live_rows(rows, group_label), "live")
    discard(first, groups)
    release(documents.sparkSession)
    for turn in range(TRIES):
        tries = stored(tried_candidates(live, links, turn).join(pairs, ["a", "b"], "left_anti"), "tries")
        more = verified(documents, feats, tries, f"try-{turn}")
        found, tried = more.count(), tries.count()
        if not found:
            discard(tries, more)
            break
        older = links, known, label, live
        links = stored(links.union(more), "links")
        known = components(links)
        label, group_label = _labels(members, known)
        live = stored(live_rows(live.drop("label"), group_label), "live")
        discard(tries, more, *older)
        release(documents.sparkSession)
        if found * ENOUGH < tried:
            break

    met = second_candidates(live, members, feats).union(
        group_label.where("label = -1").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    ).union(member_pairs(pairs, members))
    side = lambda x: label.select(
        F.col("gid").alias(x), F.col("node").alias(f"n{x}"), F.col("label").alias(f"l{x}")
    )
    apart = met.join(side("a"), "a").join(side("b"), "b").where("la <> lb")
    apart = apart.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
    rest = stored(apart.join(pairs, ["a", "b"], "left_anti"), "pairs-2")
    if rest.limit(1).count():
        more = verified(documents, feats, rest, "2")
        older = known
        known = components(links.union(more))
        discard(older, more)
    discard(pairs, rest, links, label, live, members)
    release(documents.sparkSession)

    placed = feats.select("doc_id", "n", "f1", "f2").join(nodes, ["n", "f1", "f2"], "left")
    placed = placed.join(known, "node", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return near_duplicates(documents.select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), shingled AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(list_slice(w, k, k + 4), ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM shingled GROUP BY r
), common AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingled a JOIN shingled b ON a.s = b.s AND a.r <> b.r GROUP BY ALL
), links AS MATERIALIZED (
  SELECT p.doc_id AS a, q.doc_id AS b
  FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b JOIN words p ON p.r = a JOIN words q ON q.r = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
), least_of AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM words LEFT JOIN sizes USING (r) LEFT JOIN least_of ON doc_id = a
"""
