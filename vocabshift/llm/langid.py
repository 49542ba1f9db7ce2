"""Language identification: nearest clustered centroid of normalised TF-IDF n-gram vectors.

A text is lower-cased, every run of non-letters becomes one space, and its character 1- to 3-grams are counted
in ``DIMS`` hashed cells.  Cell weights are ``log(1 + count) * idf``, scaled to length 1.

* *Corpus statistics*: document frequencies come from **all** training rows (one row per cell reaches the driver).
* *Centroids*: per language, spherical k-means over a sample of about ``SAMPLE`` training rows (a hash of id and
  text decides, with a rate from the language's row count) gives ``CLUSTERS`` centroids.
* *Prediction*: the language of the centroid with the largest cosine; score is the softmax share of that language's
  best cosine.
* *Rejection*: a text is rejected (as is one without letters) when its cosine with the nearest centroid is under
  ``MARGIN`` times the cosine that the share ``QUANTILE`` of that centroid's members of like size exceed, or under
  1 - ``CHANCE``.  Size is the number of different cells, in bands of half an octave: few cells lie far from every
  centroid by nature, and many cells lie near each by chance.  The members are the sampled texts, a piece of each at every
  length from ``SHORTEST`` characters, and joined texts of a language.  A band with fewer than ``LEAST`` different members
  takes those of all centroids, then the limit of the next smaller band, and ``CHANCE`` below the first.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; of languages with equal
cosine the alphabetically first wins; null ids are neither held out nor learned from; repeated rows are
predicted alike and counted each time in the statistics; with no training rows every text is ``und``; extra
columns of the input are ignored (or kept, by ``keep``).
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabshift.llm.common import id_remainder, map_rows, text_slices

DIMS = 4096
SAMPLE = 400
CLUSTERS = 4
ROUNDS = 12
QUANTILE = 0.995
MARGIN = 0.5
LEAST = 20
SHORTEST = 8
CHANCE = 0.95
BANDS = 2 * int(DIMS).bit_length()
SHARPNESS = 25.0
BATCH_BYTES = 400_000
BATCH_ROWS = 64

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For every code point whether it is a letter (built once per worker)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x DIMS counts, whether a row has a letter) of some texts."""
    n = len(texts)
    lowered = [(t or "").lower() for t in texts]
    joined = "\0".join(["", *lowered, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    # a text may hold NUL itself: rows come from lengths, not from separators; one opens every text
    lengths = np.array([len(t) + 1 for t in lowered], np.int64)
    row = np.append(np.repeat(np.arange(n, dtype=np.int64), lengths), n - 1)
    letter = _letter_table()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    edge = np.zeros(len(codes), bool)
    edge[np.append(0, np.cumsum(lengths))] = True
    keep |= edge
    has = np.bincount(row[letter], minlength=n)[:n] > 0
    codes, row, edge = codes[keep].astype(np.uint64), row[keep], edge[keep]
    mult = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - int(DIMS).bit_length() + 1)
    out = np.zeros(n * DIMS, np.int64)
    h = codes + np.uint64(1)
    ok = ~edge & (codes != 32)
    for size in range(1, 4):
        if size > 1:
            if len(codes) < size:
                break
            h = h[:-1] * np.uint64(1_000_003) + codes[size - 1 :] + np.uint64(1)
            # a gram may start or end at a space, and never crosses from one text to the next
            ok = ~edge[size - 1 :] & (row[: len(h)] == row[size - 1 :])
        cell = ((h ^ np.uint64(size)) * mult >> shift).astype(np.int64)
        out += np.bincount(row[size - 1 :][ok] * DIMS + cell[ok], minlength=n * DIMS)
    return out.reshape(n, DIMS), has


def bands(counts: np.ndarray) -> np.ndarray:
    """Size band of every row: half octaves of the number of different cells."""
    return (2 * np.log2(np.maximum((counts > 0).sum(axis=1), 1))).astype(int)


@dataclass
class Model:
    """Centroids (rows of ``centroids``), their language and rejection distance by size band, and cell weights."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    reach: np.ndarray
    idf: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts).astype(np.float32) * self.idf
        length = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return v / np.maximum(length, 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """(language, score, distance, rejected) of some texts."""
        counts, has = gram_counts(texts)
        if not self.languages:
            return [("und", 0.0, 1.0, True)] * len(texts)
        cosine = self.vectors(counts) @ self.centroids.T
        best = np.full((len(texts), len(self.languages)), -1.0)
        for k, owner in enumerate(self.owner):
            best[:, owner] = np.maximum(best[:, owner], cosine[:, k])
        lang = best.argmax(axis=1)
        share = np.exp((best - best.max(axis=1, keepdims=True)) * SHARPNESS)
        score = share.max(axis=1) / share.sum(axis=1)
        nearest = cosine.argmax(axis=1)
        distance = 1.0 - cosine.max(axis=1)
        rejected = distance > self.reach[nearest, bands(counts)]
        return [
            (self.languages[lang[i]], float(score[i]), float(distance[i]), bool(rejected[i]))
            if has[i]
            else ("und", 0.0, 1.0, True)
            for i in range(len(texts))
        ]


def _cluster(vectors: np.ndarray, k: int) -> np.ndarray:
    """Centres of spherical k-means from spread-out first centres."""
    centres = [vectors.mean(axis=0)]
    for _ in range(1, min(k, len(vectors))):
        near = np.max(vectors @ np.array(centres).T, axis=1)
        centres.append(vectors[int(near.argmin())])
    c = np.array(centres)
    for _ in range(ROUNDS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (vectors @ c.T).argmax(axis=1)
        c = np.array([vectors[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def pieces(text: str) -> list[str]:
    """A piece of every length ``SHORTEST``, twice that and so on below the text's own, each at a place that a hash decides."""
    out, size = [], SHORTEST
    while size < len(text):
        start = zlib.crc32(f"{size} {text}".encode("utf-8", "surrogatepass")) % (len(text) - size + 1)
        out.append(text[start : start + size])
        size *= 2
    return out


def _joined(counts: np.ndarray) -> np.ndarray:
    """Counts of the texts joined by 4, 16 and so on up to all."""
    out, size = [], 4
    while size < 4 * len(counts):
        out.append(np.add.reduceat(counts, np.arange(0, len(counts), size), axis=0))
        size *= 4
    return np.vstack(out) if out else counts[:0]


def _limits(nearest: np.ndarray, cosine: np.ndarray, band: np.ndarray, centroids: int) -> np.ndarray:
    """Rejection distance by centroid and size band from its members' cosines."""

    def limit(members: np.ndarray) -> float | None:
        if members.sum() < LEAST:
            return None
        return min(CHANCE, 1 - MARGIN * float(np.quantile(cosine[members], 1 - QUANTILE)))

    out = np.full((centroids, BANDS), CHANCE)
    for b in range(BANDS):
        of_all = limit(band == b)
        for k in range(centroids):
            own = limit((band == b) & (nearest == k))
            known = own if own is not None else of_all
            out[k, b] = known if known is not None else out[k, max(b - 1, 0)]
    return out


def _frequencies(batches):
    total = np.zeros(DIMS, np.int64)
    rows = 0
    for batch in batches:
        for _, texts in text_slices(batch, 0, BATCH_BYTES, BATCH_ROWS):
            counts, _ = gram_counts(texts)
            total += (counts > 0).sum(axis=0)
            rows += len(texts)
    cells = [*range(DIMS), -1] if rows else []
    values = [*total.tolist(), rows] if rows else []
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(values, pa.int64())], ["cell", "n"])


def _sampled(batches):
    for batch in batches:
        for part, texts in text_slices(batch, 0, BATCH_BYTES, BATCH_ROWS):
            langs = part.column(1).to_pylist()
            yield _counted(texts, langs, True)
            parts = [(p, lang) for t, lang in zip(texts, langs, strict=True) for p in pieces(t or "")]
            for i in range(0, len(parts), BATCH_ROWS):
                yield _counted(*zip(*parts[i : i + BATCH_ROWS], strict=True), False)


def _counted(texts: Sequence[str | None], langs: Sequence[str], whole: bool) -> pa.RecordBatch:
    """Language, whether it is a whole text, cells and counts of the texts with a letter."""
    counts, has = gram_counts(list(texts))
    rows = [i for i in range(len(texts)) if has[i]]
    cells = [np.flatnonzero(counts[i]).astype(np.int32) for i in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([langs[i] for i in rows], pa.string()),
            pa.array([whole] * len(rows), pa.bool_()),
            pa.array(cells, pa.list_(pa.int32())),
            pa.array([counts[i][c].astype(np.int32) for i, c in zip(rows, cells, strict=True)], pa.list_(pa.int32())),
        ],
        ["lang", "whole", "cells", "counts"],
    )


def fit(training: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """A model from (text, lang, key) rows; ``key`` is a uniform 64-bit hash that decides the sample."""
    labelled = training.where(F.col("lang").isNotNull())
    freq = map_rows(labelled.select("text"), _frequencies, "cell int, n long")
    df = {r["cell"]: r["n"] for r in freq.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    rows = df.get(-1, 0)
    idf = np.log((1 + rows) / (1 + np.array([df.get(c, 0) for c in range(DIMS)]))).astype(np.float32) + 1
    per_lang = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    chosen = F.lit(False)
    for lang, n in sorted(per_lang.items()):
        rate = min(1.0, sample / n)
        u = F.pmod(F.col("key"), F.lit(1_000_003)) / 1_000_003.0
        chosen = F.when(F.col("lang") == lang, u < rate).otherwise(chosen)
    picked = map_rows(
        labelled.where(chosen).select("text", "lang"),
        _sampled,
        "lang string, whole boolean, cells array<int>, counts array<int>",
    )
    vectors: dict[str, list] = {}
    whole: dict[str, set[bytes]] = {}
    parts: set[tuple[bytes, bytes]] = set()
    empty = Model([], np.zeros(0, int), np.zeros((0, DIMS)), np.zeros((0, BANDS)), idf)
    for r in picked.toLocalIterator():
        cells, n = np.array(r["cells"], np.int32), np.array(r["counts"], np.int32)
        if not r["whole"]:
            parts.add((cells.tobytes(), n.tobytes()))
            continue
        dense = np.zeros((1, DIMS), np.int32)
        dense[0, cells] = n
        vectors.setdefault(r["lang"], []).append(empty.vectors(dense)[0])
        whole.setdefault(r["lang"], set()).add(dense.tobytes())
    languages = sorted(vectors)
    if not languages:
        return empty
    owner, centres = [], []
    for i, lang in enumerate(languages):
        c = _cluster(np.array(sorted(map(tuple, vectors.pop(lang))), np.float32), clusters)
        owner += [i] * len(c)
        centres.append(c)
    model = Model(languages, np.array(owner), np.vstack(centres).astype(np.float32), empty.reach, idf)

    found = []
    for lang in languages:
        own = np.frombuffer(b"".join(sorted(whole.pop(lang))), np.int32).reshape(-1, DIMS)
        found += [_members(model, own), _members(model, _joined(own))]
    some = sorted(parts)
    for i in range(0, len(some), BATCH_ROWS):
        dense = np.zeros((len(some[i : i + BATCH_ROWS]), DIMS), np.int32)
        for k, (cells, n) in enumerate(some[i : i + BATCH_ROWS]):
            dense[k, np.frombuffer(cells, np.int32)] = np.frombuffer(n, np.int32)
        found.append(_members(model, dense))
    model.reach = _limits(*map(np.concatenate, zip(*found, strict=True)), len(model.owner))
    return model


def _members(model: Model, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, cosine with it, size band) of some texts' counts."""
    cosine = model.vectors(counts) @ model.centroids.T
    return cosine.argmax(axis=1), cosine.max(axis=1), bands(counts)


def training_rows(documents: DataFrame, usable: Column) -> DataFrame:
    """(text, lang, key) of the rows that may be learned from."""
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    return documents.where(usable).select("text", "lang", key.alias("key"))


def held_out(modulus: int = 3, remainder: int = 1) -> Column:
    """Whether a row is held out of training."""
    return id_remainder("doc_id", modulus) == remainder


def fit_documents(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the rows that are not held out; null ids are not learned from."""
    return fit(training_rows(documents, id_remainder("doc_id", 3).isin(0, 2)), sample)


def identify(documents: DataFrame, model: Model, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keep`` columns + lang_pred, score, distance, rejected."""
    source = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"))

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, len(keep), BATCH_BYTES, BATCH_ROWS):
                cols = zip(*model.predict(texts), strict=True)
                kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                    [*part.schema.names[: len(keep)], "lang_pred", "score", "distance", "rejected"],
                )

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    schema = (base + ", " if base else "") + "lang_pred string, score double, distance double, rejected boolean"
    found = map_rows(source, run, schema)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *found.columns[len(keep) :])


def report(documents: DataFrame) -> DataFrame:
    """Every document's predicted language, learned from the rows that are not held out."""
    docs = documents.withColumn("held_out", held_out())
    return identify(docs, fit_documents(documents), ("doc_id", "held_out"))
