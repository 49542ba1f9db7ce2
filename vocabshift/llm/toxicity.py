"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A text is lower-cased and cut into sentences (``. ! ?`` and line ends) and words (runs of letters and digits).
A word's features are the whole word and its first 3 to 8 characters, hashed into ``DIMS`` cells.  A sentence's
probability is ``sigmoid(bias + sum of its words' weights)`` and a document's ``1 - prod(1 - p)`` over its sentences:
one offending sentence is enough, and clean sentences don't dilute it.  Training sees document labels only.

* *Sample*: about ``SAMPLE[label]`` labelled rows per label, chosen by a hash of the id with a rate from the label's
  row count (a bound that is a parameter); only these ids are joined to the documents, by broadcast.
* *Fit*: proximal gradient descent on the noisy-or likelihood with an L1 penalty, so the weights stay sparse.  The two
  labels are weighted back to their share among the labelled rows.
* *Locating*: sentences with probability at least ``SENTENCE`` are reported with their character range.

Defined cases: a null or wordless text has no sentence and score 0; rows without a label, with a null label or a null id
are not learned from; several labels for an id count as the largest; with no usable label of either kind every
score is 0; every input row gives one output row; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabshift.llm.common import id_remainder, map_rows, text_slices

DIMS = 1 << 20
SAMPLE = {1: 1200, 0: 3600}
LEAST_DOCS = 3
STEPS = 150
L1 = 2e-4
SENTENCE = 0.5
PREFIXES = range(3, 9)
WIDTH = 1 + len(PREFIXES)
SLICE_BYTES, SLICE_ROWS = 4_000_000, 1_024

WORD = re.compile(r"[^\W_]+")
END = re.compile(r"[.!?\n]+")


def _hash_words(words: list[str]) -> np.ndarray:
    """(words x WIDTH) cells: the word and its prefixes; cell 0 stands for a prefix that is not shorter."""
    n = len(words)
    if not n:
        return np.zeros((0, WIDTH), np.int32)
    lengths = np.fromiter(map(len, words), np.int64, n)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(lengths) - lengths
    mult, mix = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - DIMS.bit_length() + 1)
    out = np.zeros((n, WIDTH), np.int32)
    h = np.full(n, 0xCBF29CE484222325, np.uint64)
    alive = np.arange(n)
    for k in range(1, int(lengths.max()) + 1):
        alive = alive[lengths[alive] >= k]
        h[alive] = (h[alive] ^ codes[start[alive] + k - 1]) * mult
        if k in PREFIXES:
            longer = alive[lengths[alive] > k]
            cells = ((h[longer] ^ np.uint64(k)) * mix >> shift).astype(np.int32)
            out[longer, 1 + k - PREFIXES[0]] = np.maximum(cells, 1)
    out[:, 0] = np.maximum((h * mix >> shift).astype(np.int32), 1)
    return out


def read_text(text: str | None) -> tuple[list[str], np.ndarray, list[tuple[int, int]]]:
    """(words, sentence number of each word, character range of each sentence that has words)."""
    words: list[str] = []
    where: list[int] = []
    ranges: list[tuple[int, int]] = []
    if text:
        at = 0
        for stop in [*[(m.start(), m.end()) for m in END.finditer(text)], (len(text), len(text))]:
            found = WORD.findall(text, at, stop[0])
            if found:
                words += [w.lower() for w in found]
                where += [len(ranges)] * len(found)
                ranges.append((at, stop[1]))
            at = stop[1]
    return words, np.array(where, np.int64), ranges


@dataclass
class Model:
    """Cell weights and the sentence bias; ``weights`` is None where there was nothing to learn from."""

    weights: np.ndarray | None
    bias: float

    def sentences(self, text: str | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Probability and character range of every sentence with words."""
        words, where, ranges = read_text(text)
        if not words or self.weights is None:
            return np.zeros(0), []
        total = np.bincount(where, self.weights[_hash_words(words)].sum(axis=1), len(ranges))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30))), ranges

    def score(self, probabilities: np.ndarray) -> float:
        return float(-np.expm1(np.log1p(-np.minimum(probabilities, 1 - 1e-12)).sum()))


def _featurised(batches):
    for batch in batches:
        rows = [(*read_text(t), y) for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        cells = [_hash_words(w).tobytes() for w, _, _, _ in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([y for *_, y in rows], pa.int32()),
                pa.array(cells, pa.binary()),
                pa.array([s.astype(np.int32).tobytes() for _, s, _, _ in rows], pa.binary()),
            ],
            ["label", "cells", "sentences"],
        )


def fit(documents: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model:
    """A model from ``labels`` (doc_id, toxic) that may be learned from, and the documents' texts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(None, 0.0)
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    rate = {y: min(1.0, sample[y] / n[y]) for y in n}
    chosen = known.where(F.when(F.col("label") == 1, u < rate[1]).otherwise(u < rate[0]))
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    rows = list(map_rows(texts, _featurised, "label int, cells binary, sentences binary").toLocalIterator())
    rows = sorted((r["label"], bytes(r["cells"]), bytes(r["sentences"])) for r in rows if len(r["cells"]))
    if len({y for y, _, _ in rows}) < 2:
        return Model(None, 0.0)
    return _train(rows, n)


def _train(rows: list[tuple[int, bytes, bytes]], n: dict[int, int]) -> Model:
    y = np.array([r[0] for r in rows], float)
    cells = [np.frombuffer(r[1], np.int32).reshape(-1, WIDTH) for r in rows]
    where = [np.frombuffer(r[2], np.int32) for r in rows]
    docs_with = np.zeros(DIMS, np.int32)
    for c, label in zip(cells, y, strict=True):
        if label:
            docs_with[np.unique(c)] += 1
    used = docs_with >= LEAST_DOCS
    used[0] = False
    number = np.cumsum(used) - 1
    counts = np.array([int(s[-1]) + 1 for s in where])
    first = np.cumsum(counts) - counts
    sent, feat = [], []
    for c, s, base in zip(cells, where, first, strict=True):
        keep = used[c]
        sent.append(np.broadcast_to((s + base)[:, None], c.shape)[keep].astype(np.int32))
        feat.append(number[c[keep]].astype(np.int32))
    sent, feat = np.concatenate(sent), np.concatenate(feat)
    doc_of = np.repeat(np.arange(len(rows)), counts)
    share = np.array([n[0] / (y == 0).sum(), n[1] / (y == 1).sum()]) / (n[0] + n[1])
    weight = share[y.astype(int)]
    w, bias = np.zeros(int(used.sum())), -4.0
    pace, bias_pace = np.full(len(w), 1e-10), 1e-10
    rate = 0.5
    for _ in range(STEPS):
        z = np.bincount(sent, w[feat], len(doc_of)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(rows))
        doc_p = np.maximum(-np.expm1(none), 1e-9)
        pull = np.where(y == 1, -np.exp(none) / doc_p, 1.0) * weight
        g_z = p * pull[doc_of]
        g, g_b = np.bincount(feat, g_z[sent], len(w)), float(g_z.sum())
        pace += g * g
        bias_pace += g_b * g_b
        step = rate / np.sqrt(pace)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        bias -= rate / np.sqrt(bias_pace) * g_b
    weights = np.zeros(DIMS, np.float32)
    weights[used] = w
    return Model(weights, float(bias))


def held_out():
    """Whether a row is held out of training."""
    return id_remainder("doc_id", 5) == 0


def score_documents(documents: DataFrame, model: Model, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keep`` columns + score, sentences (number with words) and offending (start, end, probability)."""
    source = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def run(batches):
        own = shared.value
        for part, texts in (x for b in batches for x in text_slices(b, len(keep), SLICE_BYTES, SLICE_ROWS)):
            scores, numbers, located = [], [], []
            for text in texts:
                p, ranges = own.sentences(text)
                scores.append(own.score(p) if len(p) else 0.0)
                numbers.append(len(p))
                located.append(
                    [{"start": ranges[i][0], "end": ranges[i][1], "probability": p[i]} for i in np.flatnonzero(p >= SENTENCE)]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[: len(keep)],
                    pa.array(scores, pa.float64()),
                    pa.array(numbers, pa.int64()),
                    pa.array(located, pa.list_(span)),
                ],
                [*part.schema.names[: len(keep)], "score", "sentences", "offending"],
            )

    base = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[: len(keep)])
    found = map_rows(
        source,
        run,
        base + "score double, sentences long, offending array<struct<start:long,end:long,probability:double>>",
    )
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score", "sentences", "offending")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's toxicity, learned from the labels of the rows that are not held out."""
    model = fit(documents, labels.where(id_remainder("doc_id", 5).between(1, 4)))
    found = score_documents(documents.withColumn("held_out", held_out()), model, ("doc_id", "held_out"))
    return found.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
