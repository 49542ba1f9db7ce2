"""SentencePiece encoding and decoding as best paths, giant documents by a max-plus parallel scan.

A text is prefixed with the space mark, spaces become space marks, and the segmentation with the largest sum of piece
scores is taken; of equally good ones the path whose last piece is longest, from the end backwards.  A character in no
piece costs the least score less ten and is written as its UTF-8 byte pieces.  Scores are fixed-point integers, so sums
are exact and (max, +) is associative: every way of splitting the work gives the same pieces.

*Ordinary documents* are encoded where they are read.  Where no piece has a space mark after another character, every
path passes each word start, so a text is the concatenation of its words' best paths and frequent words are remembered.

*Giant documents* (over ``CHUNK`` characters) are cut into chunks of ``CHUNK`` characters, wherever that falls:

1. each chunk yields its *transfer matrix*: entry (i, j) is the best score from i characters before its start to j
   characters before its end, for i and j below the longest piece.  Its first and last inner word starts part it into a
   head, a middle of whole words and a tail; the matrix is the max-plus product of the head's column (a score for each
   i), the middle's score and the tail's row (a score for each j).  A chunk without them is computed from each i;
2. matrices are combined associatively, ``FAN`` at a time and level by level, which gives every chunk the scores at
   its start;
3. with these, each chunk maps a state at its end to the state at its start that the backtrace reaches; these maps
   are composed from the right in the same way, which gives every chunk its end state;
4. each chunk is traced back on its own (the middle's pieces are known from step 1); a document's pieces are its
   chunks' in order.

Defined cases: a null text has null ids, an empty one none; the space mark itself decodes to a space (so a text that
holds it comes back with spaces); repeated rows are encoded each; an empty table gives no rows; extra columns are
ignored (or kept, by ``keep``).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabshift.llm.common import map_rows, stored, text_slices

MARK = "▁"
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
FAN = 256
REMEMBERED = 200_000
POINT = 1 << 10
UNKNOWN_PENALTY = 10
NEVER = -(1 << 60)
LATIN = 0x250
WORDS_AT_ONCE = 20_000
LONGEST_WORD = 64
SLICE_BYTES, SLICE_ROWS, SLICE_IDS = 1_500_000, 4_096, 500_000
WORD = re.compile(rf"{MARK}+[^{MARK}]*")


@dataclass
class Vocabulary:
    """Pieces with fixed-point scores; ``byte_ids`` are the pieces of single bytes."""

    pieces: list[str]
    scores: list[int]
    matched: list[bool]
    byte_ids: list[int]
    table: dict = field(default_factory=dict, repr=False)
    words: dict = field(default_factory=dict, repr=False)
    arrays: list = field(default_factory=list, repr=False)
    worth: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64), repr=False)

    def __post_init__(self):
        used = [i for i, m in enumerate(self.matched) if m]
        self.longest = max((len(self.pieces[i]) for i in used), default=1)
        self.unknown = min((self.scores[i] for i in used), default=0) - UNKNOWN_PENALTY * POINT
        self.by_word = not any(MARK in self.pieces[i].lstrip(MARK) for i in used)

    def __getstate__(self):
        return {**self.__dict__, "table": {}, "words": {}, "arrays": [], "worth": self.worth[:0]}

    def release(self) -> None:
        """Forget what a task built; a worker outlives its tasks, and other work needs the memory."""
        self.table.clear()
        self.words.clear()
        self.arrays.clear()

    def lookup(self) -> dict:
        """Piece -> (id, score); proper prefixes of pieces that are none themselves -> None."""
        if not self.table:
            for i, piece in enumerate(self.pieces):
                if self.matched[i]:
                    self.table[piece] = (i, self.scores[i])
            for piece in list(self.table):
                for k in range(1, len(piece)):
                    self.table.setdefault(piece[:k], None)
        return self.table

    # -- many words at once --------------------------------------------------------------------------

    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(column of a code point, child by node and column, score and id of each node) of Latin pieces.

        Column -1 is a character of no piece, -2 one of pieces in other scripts.
        """
        if not self.arrays:
            table = self.lookup()
            usual = {c for p in table for c in p if ord(c) < LATIN or c == MARK}
            column = np.full(0x110000, -1, np.int16)
            for c in {c for p in table for c in p}:
                column[ord(c)] = -2
            for k, c in enumerate(sorted(usual)):
                column[ord(c)] = k
            nodes = {"": 0}
            for p in sorted((p for p in table if usual.issuperset(p)), key=len):
                nodes[p] = len(nodes)
            none = len(nodes)  # one row more, without children, stands for "no node"
            child = np.full((none + 1, len(usual)), none, np.uint16 if none < 1 << 16 else np.int32)
            score, piece = np.full(none + 1, 2 * NEVER, np.int64), np.full(none + 1, -1, np.int32)
            for p, k in nodes.items():
                if p:
                    child[nodes[p[:-1]], column[ord(p[-1])]] = k
                    if table[p] is not None:
                        piece[k], score[k] = table[p]
            self.arrays.extend((column, child, score, piece))
        return tuple(self.arrays)

    def remember(self, words: list[str]) -> None:
        """Best paths of marked words into ``words`` (as int32 bytes): one position of all words at a time."""
        column, child, score, piece = self.trie()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        byte_id = np.array([*self.byte_ids[:128], -1] if self.byte_ids else [-1] * 129, np.int32)
        for a in range(0, len(words), WORDS_AT_ONCE):
            some = order[a : a + WORDS_AT_ONCE]
            own, n = [words[k] for k in some], lengths[some]
            width, size = int(n[-1]), len(own)
            points = np.full((size, width), 128, np.uint32)
            inside = np.arange(width)[None, :] < n[:, None]
            points[inside] = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
            points = np.ascontiguousarray(points.T)
            codes = column[points]
            # a character of no piece that is more than one byte, or of another script, goes position by position
            plain = ~((codes == -2) | ((codes == -1) & (points >= 128))).T.any(axis=1, where=inside)
            best = np.full((width + 1, size), NEVER, np.int64)
            best[0] = 0
            start, last = np.zeros((width + 1, size), np.int32), np.zeros((width + 1, size), np.int32)
            for i in range(width):
                at = np.flatnonzero((n > i) & plain)
                base, node = best[i, at], np.zeros(len(at), np.int32)
                single = child[0, codes[i, at]]
                none = (codes[i, at] < 0) | (piece[single] < 0)
                if none.any():
                    to, total = at[none], base[none] + self.unknown
                    better = total > best[i + 1, to]
                    to = to[better]
                    best[i + 1, to], start[i + 1, to] = total[better], i
                    last[i + 1, to] = byte_id[np.minimum(points[i, to], 128)]
                for j in range(i, min(i + self.longest, width)):
                    col = codes[j, at]
                    node = np.where(col >= 0, child[node, col], len(piece) - 1)
                    on = node < len(piece) - 1
                    if not on.all():
                        at, node, base = at[on], node[on], base[on]
                        if not len(at):
                            break
                    total = base + score[node]
                    better = total > best[j + 1, at]
                    to = at[better]
                    best[j + 1, to], start[j + 1, to], last[j + 1, to] = total[better], i, piece[node[better]]
            # trace all words back together; ids fill their rows from the right
            ids, used = np.zeros((size, width), np.int32), np.zeros(size, np.int64)
            at, pos = np.flatnonzero(plain), n[plain]
            while len(at):
                used[at] += 1
                ids[at, width - used[at]] = last[pos, at]
                pos = start[pos, at].astype(np.int64)
                at, pos = at[pos > 0], pos[pos > 0]
            raw, row = ids.tobytes(), 4 * width
            ends = ((np.arange(size) + 1) * row).tolist()
            firsts = ((np.arange(size) + 1) * row - 4 * used).tolist()
            for word, first, end, ok in zip(own, firsts, ends, plain.tolist(), strict=True):
                self.words[word] = raw[first:end] if ok else self._bytes(word)

    def _bytes(self, s: str) -> bytes:
        return np.array(self.best_path(s), np.int32).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of some texts (None for None)."""
        found = self.encode_bytes([None if t is None else marked(t) if t else "" for t in texts])
        return [None if x is None else np.frombuffer(x, np.int32).tolist() for x in found]

    def encode_bytes(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of some marked texts, as int32 bytes."""
        if not self.by_word:
            return [None if t is None else self._bytes(t) for t in texts]
        known = self.words
        cuts = [WORD.findall(t) if t else [] for t in texts]
        new = {w for cut_text in cuts for w in cut_text if w not in known}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = {w for cut_text in cuts for w in cut_text}
        short = [w for w in new if len(w) <= LONGEST_WORD]
        if short:
            self.remember(short)
        long = [w for w in new if len(w) > LONGEST_WORD]
        for w in long:
            known[w] = self._bytes(w)
        out = [
            None if text is None else b"".join(map(known.__getitem__, cut_text))
            for text, cut_text in zip(texts, cuts, strict=True)
        ]
        for w in long:
            del known[w]
        return out

    def score(self, ids: bytes) -> int:
        """The score of ids as int32 bytes: a character written as bytes counts once, at its first byte."""
        if not len(self.worth):
            self.worth = np.array(self.scores, np.int64)
            for byte, i in enumerate(self.byte_ids):
                self.worth[i] = 0 if 0x80 <= byte < 0xC0 else self.unknown
        return int(self.worth[np.frombuffer(ids, np.int32)].sum())

    # -- best paths ---------------------------------------------------------------------------------

    def forward(self, s: str, known: list[int]) -> tuple[list[int], list[int], list[int]]:
        """Best scores at every position, and the start and id of the best last piece there.

        ``known`` are the scores at positions 0 to len(known) - 1; later ones are computed.
        """
        table, unknown, n = self.lookup(), self.unknown, len(s)
        edge = len(known) - 1
        best = known + [NEVER] * (n - edge)
        start, piece = [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            base = best[i]
            if base <= NEVER // 2:
                continue
            single = False
            for j in range(i + 1, min(i + self.longest, n) + 1):
                found = table.get(s[i:j], 0)
                if found == 0:
                    break
                if found is not None:
                    single = single or j == i + 1
                    if j > edge and base + found[1] > best[j]:
                        best[j], start[j], piece[j] = base + found[1], i, found[0]
            if not single and i + 1 > edge and base + unknown > best[i + 1]:
                best[i + 1], start[i + 1], piece[i + 1] = base + unknown, i, -1
        return best, start, piece

    def trace(self, s: str, start: list[int], piece: list[int], end: int, stop: int) -> tuple[list[int], int]:
        """(ids back from ``end`` to the first position not beyond ``stop``, that position)."""
        out: list[int] = []
        while end > stop:
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                out += [self.byte_ids[b] for b in reversed(s[start[end] : end].encode("utf-8", "surrogatepass"))]
            end = start[end]
        return out[::-1], end

    def best_path(self, s: str) -> list[int]:
        """Ids of a marked text, position by position."""
        _, start, piece = self.forward(s, [0])
        return self.trace(s, start, piece, len(s), 0)[0]

    def decode(self, ids) -> str:
        """The text of some ids."""
        first, last = (self.byte_ids[0], self.byte_ids[-1]) if self.byte_ids else (1, 0)
        parts: list[str] = []
        raw = bytearray()
        for i in ids:
            if first <= i <= last:
                raw.append(i - first)
                continue
            if raw:
                parts.append(raw.decode("utf-8", "surrogatepass"))
                raw.clear()
            parts.append(self.pieces[i])
        if raw:
            parts.append(raw.decode("utf-8", "surrogatepass"))
        return "".join(parts).replace(MARK, " ")[1:]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK)


def load(model_file: str = MODEL_FILE) -> Vocabulary:
    """The pieces and scores of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.vocab_size()
    byte_ids = [i for i in range(n) if model.is_byte(i)]
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
    return Vocabulary(
        [model.id_to_piece(i) for i in range(n)],
        [round(model.get_score(i) * POINT) for i in range(n)],
        plain,
        byte_ids,
    )


# -- giant documents ------------------------------------------------------------------------------------


def cut(n: int, vocabulary: Vocabulary, chunk: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of ``n`` characters; none is shorter than the longest piece, so no piece spans three."""
    least = max(vocabulary.longest, 2)
    at, size = 0, max(chunk, least)
    while at < n:
        end = at + size if n - at - size >= least else n
        yield at, end
        at = end


@dataclass
class Part:
    """A chunk after the characters before it, parted at word starts.

    ``head`` begins with ``edge`` characters of the chunks before.  ``mid`` are the ids of the whole words between head and
    tail; without them (None) the head is all of the chunk.
    """

    edge: int
    head: str
    mid: bytes | None = None
    tail: str | None = None


def part(vocabulary: Vocabulary, context: str, body: str) -> tuple[Part, str]:
    """A chunk's part, and the words between its head and tail (to be encoded)."""
    s, edge = context + body, len(context)
    if vocabulary.by_word:
        first = s.find(MARK, edge)
        while first > 0 and s[first - 1] == MARK:
            first = s.find(MARK, first + 1)
        # every state at the end lies at or behind the last word start
        last = s.rfind(MARK, first, max(len(s) - vocabulary.longest + 2, 0)) if first >= 0 else -1
        while last > first and s[last - 1] == MARK:
            last = s.rfind(MARK, first, last)
        if last >= 0:
            return Part(edge, s[:first], b"", s[last:]), s[first:last]
    return Part(edge, s), ""


def transfer(vocabulary: Vocabulary, p: Part) -> np.ndarray:
    """The chunk's max-plus transfer matrix between the last ``longest`` positions before its start and end."""
    width = vocabulary.longest
    out = np.full((width, width), NEVER, np.int64)
    whole = p.mid is None
    if not whole:
        behind = vocabulary.score(p.mid) + np.array(vocabulary.forward(p.tail, [0])[0][: -width - 1 : -1])
    for state in range(p.edge + 1):
        known = [NEVER] * (p.edge + 1)
        known[p.edge - state] = 0
        best = vocabulary.forward(p.head, known)[0]
        if whole:
            ends = best[: -width - 1 : -1]
            out[state, : len(ends)] = ends
        elif best[-1] > NEVER // 2:  # else no piece leads from this state over the chunk's start
            out[state, : len(behind)] = best[-1] + behind
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER)


def _from_start(vocabulary: Vocabulary, p: Part, vector: np.ndarray):
    """Best paths through the head from the scores of the states at the chunk's start."""
    known = [max(int(vector[p.edge - at]), NEVER) for at in range(p.edge + 1)]
    return vocabulary.forward(p.head, known)


def back_map(vocabulary: Vocabulary, p: Part, vector: np.ndarray) -> np.ndarray:
    """For every state at the chunk's end the state at its start that the backtrace reaches."""
    _, start, _ = _from_start(vocabulary, p, vector)
    out = np.zeros(vocabulary.longest, np.int64)
    for state in range(vocabulary.longest):
        at = len(p.head) - (state if p.mid is None else 0)
        while at > p.edge:
            at = start[at]
        out[state] = p.edge - at
    return out


def chunk_ids(vocabulary: Vocabulary, p: Part, vector: np.ndarray, end_state: int) -> list[int]:
    """Ids of the pieces that end inside the chunk, back from its end state."""
    _, start, piece = _from_start(vocabulary, p, vector)
    if p.mid is None:
        return vocabulary.trace(p.head, start, piece, len(p.head) - end_state, p.edge)[0]
    ids = vocabulary.trace(p.head, start, piece, len(p.head), p.edge)[0]
    ids += np.frombuffer(p.mid, np.int32).tolist()
    _, start, piece = vocabulary.forward(p.tail, [0])
    return ids + vocabulary.trace(p.tail, start, piece, len(p.tail) - end_state, 0)[0]


def parts(vocabulary: Vocabulary, chunks: list[tuple[str, str]]) -> list[Part]:
    """The parts of some (context, body) chunks, their middles encoded together."""
    found = [part(vocabulary, context, body) for context, body in chunks]
    middles = vocabulary.encode_bytes([words for _, words in found])
    return [Part(p.edge, p.head, None if p.mid is None else m, p.tail) for (p, _), m in zip(found, middles, strict=True)]


def _chunk_rows(vocabulary: Vocabulary, n_keep: int, chunk: int):
    """Partition function: giant documents to chunk rows (kept columns only in the first)."""

    def run(batches):
        context = TaskContext.get()
        task, seq = (context.partitionId() if context else 0), 0
        for batch in batches:
            for i, text in enumerate(batch.column(n_keep).to_pylist()):
                s = marked(text)
                key, seq = f"{task}-{seq}", seq + 1
                rows = list(cut(len(s), vocabulary, chunk))
                left = vocabulary.longest - 1
                for a in range(0, len(rows), 64):
                    some = rows[a : a + 64]
                    n = len(some)
                    kept = [
                        pa.concat_arrays([c.slice(i, 1), pa.nulls(n - 1, c.type)]) if a == 0 else pa.nulls(n, c.type)
                        for c in batch.columns[:n_keep]
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *kept,
                            pa.array([key] * n),
                            pa.array(range(a, a + n), pa.int64()),
                            pa.array([s[max(0, x - left) : x] for x, _ in some]),
                            pa.array([s[x:y] for x, y in some]),
                        ],
                        [*batch.schema.names[:n_keep], "row", "idx", "context", "body"],
                    )

    return run


def _part_rows(shared):
    """Partition function: chunk rows to parts and transfer matrices."""

    def run(batches):
        own = shared.value
        for rows in (b.slice(i, 16) for b in batches for i in range(0, b.num_rows, 16)):
            found = parts(own, list(zip(*(rows.column(c).to_pylist() for c in ("context", "body")), strict=True)))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("row"),
                    rows.column("idx"),
                    pa.array([p.edge for p in found], pa.int32()),
                    pa.array([p.head for p in found], pa.string()),
                    pa.array([p.mid for p in found], pa.binary()),
                    pa.array([p.tail for p in found], pa.string()),
                    pa.array([_int64s(transfer(own, p)) for p in found], pa.binary()),
                ],
                ["row", "idx", "edge", "head", "mid", "tail", "op"],
            )
        own.release()

    return run


def _int64s(values) -> bytes:
    return np.ascontiguousarray(values, np.int64).tobytes()


def _scan(items: DataFrame, last: int, join_two, apply, first: bytes, backwards: bool) -> DataFrame:
    """Exclusive scan of (row, idx, op): the state before every item, by groups of ``FAN`` and level by level.

    ``join_two(a, b)`` combines two items (a before b), ``apply(state, op)`` moves a state over one item; the state before
    the first item (the last, backwards) is ``first``.  ``last`` is the largest idx.
    """
    group = F.floor(F.col("idx") / FAN).cast("long")
    ops = items.select("row", "idx", "op", group.alias("g"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ascending=not backwards)
        state = pdf["state"].iloc[0]
        states = []
        for op in pdf["op"]:
            states.append(state)
            state = apply(state, op)
        return pd.DataFrame({"row": pdf["row"], "idx": pdf["idx"], "state": states})

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        found = None
        for op in pdf.sort_values("idx", ascending=not backwards)["op"]:
            found = op if found is None else join_two(found, op)
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "idx": [pdf["g"].iloc[0]], "op": [found]})

    if last < FAN:
        seeded = ops.withColumn("state", F.lit(first))
    else:
        upper = ops.groupBy("row", "g").applyInPandas(product, "row string, idx long, op binary")
        states = _scan(stored(upper, "scan"), last // FAN, join_two, apply, first, backwards)
        seeded = ops.join(states.withColumnRenamed("idx", "g"), ["row", "g"])
    return seeded.groupBy("row", "g").applyInPandas(inside, "row string, idx long, state binary")


def _per_chunk(chunks: DataFrame, shared, fn, column: str, kind: pa.DataType, spark_kind: str) -> DataFrame:
    """(row, idx, ``column``) by a function of the vocabulary and a chunk row."""

    def run(batches):
        for rows in (b.slice(i, 16).to_pylist() for b in batches for i in range(0, b.num_rows, 16)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["row"] for r in rows], pa.string()),
                    pa.array([r["idx"] for r in rows], pa.int64()),
                    pa.array([fn(shared.value, r) for r in rows], kind),
                ],
                ["row", "idx", column],
            )
        shared.value.release()

    return map_rows(chunks, run, f"row string, idx long, {column} {spark_kind}")


def encode_giant(giant: DataFrame, vocabulary: Vocabulary, n_keep: int, chunk: int = CHUNK) -> DataFrame:
    """Kept columns, ids of (kept columns, text) rows by the parallel scan."""
    width = vocabulary.longest
    base = [f"`{f.name}` {f.dataType.simpleString()}" for f in giant.schema.fields[:n_keep]]
    names = giant.columns[:n_keep]
    schema = ", ".join([*base, "row string, idx long, context string, body string"])
    chunks = stored(map_rows(giant, _chunk_rows(vocabulary, n_keep, chunk), schema), "chunks")
    last = chunks.agg(F.max("idx")).first()[0] or 0
    shared = giant.sparkSession.sparkContext.broadcast(vocabulary)
    vec = lambda b: np.frombuffer(b, np.int64)
    square = lambda b: vec(b).reshape(width, width)
    own = lambda r: Part(r["edge"], r["head"], r["mid"], r["tail"])

    schema = "row string, idx long, edge int, head string, mid binary, tail string, op binary"
    parted = stored(map_rows(chunks.drop(*names), _part_rows(shared), schema), "parts")
    start = np.full(width, NEVER, np.int64)
    start[0] = 0
    forward = stored(
        _scan(
            parted.select("row", "idx", "op"),
            last,
            lambda a, b: _int64s(combine(square(a), square(b))),
            lambda v, m: _int64s(np.maximum((vec(v)[:, None] + square(m)).max(axis=0), NEVER)),
            _int64s(start),
            False,
        ),
        "forward",
    )
    # of a part's middle and tail a map only needs to know that they are there
    some = parted.select(
        "row", "idx", "edge", "head", F.when(F.col("mid").isNotNull(), F.lit(b"")).alias("mid"), F.lit("").alias("tail")
    )
    maps = _per_chunk(
        some.join(forward, ["row", "idx"]),
        shared,
        lambda v, r: _int64s(back_map(v, own(r), vec(r["state"]))),
        "op",
        pa.binary(),
        "binary",
    )
    # backwards, a state is the end state of an item: over an item, s becomes its map at s
    ends = _scan(
        stored(maps, "maps"),
        last,
        lambda a, b: _int64s(vec(b)[vec(a)]),
        lambda s, m: _int64s([vec(m)[vec(s)[0]]]),
        _int64s([0]),
        True,
    )
    states = forward.join(ends.withColumnRenamed("state", "end"), ["row", "idx"])
    traced = _per_chunk(
        parted.drop("op").join(states, ["row", "idx"]),
        shared,
        lambda v, r: chunk_ids(v, own(r), vec(r["state"]), int(vec(r["end"])[0])),
        "ids",
        pa.list_(pa.int32()),
        "array<int>",
    )
    whole = traced.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("idx", "ids"))).alias("c"))
    ids = whole.select("row", F.flatten(F.transform("c", lambda x: x["ids"])).alias("ids"))
    return chunks.where("idx = 0").select("row", *names).join(ids, "row").drop("row")


# -- operators ------------------------------------------------------------------------------------------


def _ids_array(ids: list[bytes | None]) -> pa.Array:
    sizes = np.fromiter((len(x) // 4 if x else 0 for x in ids), np.int64, len(ids))
    flat = np.frombuffer(b"".join(x for x in ids if x), np.int32)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([x is None for x in ids], pa.bool_()))


def _decoded(vocabulary: Vocabulary, batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch of bounded size with the texts of the ids in column ``at``."""
    sizes = batch.column(at).value_lengths().to_pylist()
    start = held = 0
    for i, size in enumerate([*sizes, SLICE_IDS]):
        if i == len(sizes) or (held + (size or 0) > SLICE_IDS and i > start):
            part = batch.slice(start, i - start)
            values = part.column(at).flatten().to_numpy(zero_copy_only=False)
            texts, upto = [], 0
            for n in sizes[start:i]:
                texts.append(None if n is None else vocabulary.decode(values[upto : upto + n].tolist()))
                upto += n or 0
            if texts:
                yield part, texts
            start, held = i, 0
        held += size or 0


def encode(
    documents: DataFrame,
    vocabulary: Vocabulary | None = None,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """``keep`` columns + ids (array<int>, null for a null text)."""
    vocabulary = vocabulary or load()
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    n = len(keep)
    source = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"))
    giant = F.length("t") > chunk

    def run(batches):
        own = shared.value
        for part, texts in (x for b in batches for x in text_slices(b, n, SLICE_BYTES, SLICE_ROWS)):
            some = [None if t is None else marked(t) if t else "" for t in texts]
            ids = _ids_array(own.encode_bytes(some))
            yield pa.RecordBatch.from_arrays([*part.columns[:n], ids], [*part.schema.names[:n], "ids"])
        own.release()

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:n]) + "ids array<int>"
    ordinary = map_rows(source.where(~F.coalesce(giant, F.lit(False))), run, schema)
    both = ordinary.unionByName(encode_giant(source.where(giant), vocabulary, n, chunk))
    return both.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids")


def decode(
    encoded: DataFrame, vocabulary: Vocabulary | None = None, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids"
) -> DataFrame:
    """``keep`` columns + text of the ids (null for null)."""
    vocabulary = vocabulary or load()
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    n = len(keep)
    source = encoded.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(ids_col).alias("ids"))

    def run(batches):
        own = shared.value
        for batch in batches:
            for part, texts in _decoded(own, batch, n):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], pa.array(texts, pa.string())], [*part.schema.names[:n], "text"]
                )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:n]) + "text string"
    return map_rows(source, run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")


def report(documents: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """Ids of every document, their number, and whether they decode to the text again (null for null texts)."""
    vocabulary = load(model_file)
    mark = F.translate("text", MARK, " ").cast("binary")
    source = documents.select("doc_id", "text", F.crc32(mark).alias("crc"), F.length("text").alias("n_chars"))
    encoded = encode(source, vocabulary, ("doc_id", "crc", "n_chars"))
    return _checked(encoded, vocabulary)


def _checked(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip: the decoded text's checksum and length are those of the text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own = shared.value
        for batch in batches:
            for part, texts in _decoded(own, batch, 3):
                doc, crc, size, ids = part.columns
                same = [
                    None if t is None else len(t) == k and zlib.crc32(t.encode("utf-8", "surrogatepass")) == c
                    for t, c, k in zip(texts, crc.to_pylist(), size.to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [doc, ids.value_lengths().cast(pa.int64()), ids, pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "ids", "round_trip"],
                )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_rows(encoded, run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")
