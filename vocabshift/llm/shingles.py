"""Hashed word shingles of whole texts, many texts at a time."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * MIX) ^ (np.arange(1, 257, dtype=np.uint64) * STEP >> np.uint64(17))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return (h ^ (h >> np.uint64(29))) * STEP ^ (h >> np.uint64(31))


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts in order, words per text); A-Z count as a-z if ``lower``."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if lower:
        raw = [r.lower() for r in raw]
    b = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    start = ~space
    start[1:] &= space[:-1]
    first = np.flatnonzero(start)
    edges = np.cumsum([0, *[len(r) + 1 for r in raw]])
    per_text = np.diff(np.searchsorted(first, edges))
    if not len(first):
        return np.zeros(0, np.uint64), per_text
    kept = b[~space]
    at = np.cumsum(~space)[first] - 1
    lengths = np.diff(np.append(at, len(kept)))
    pos = np.arange(len(kept)) - np.repeat(at, lengths)
    powers = np.full(int(lengths.max()), STEP | np.uint64(1), np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    h = np.add.reduceat(_BYTE[kept] * powers[pos], at)
    return _mixed(h + lengths.astype(np.uint64)), per_text


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """Per text its distinct shingle hashes in ascending order (shorter texts: all words as one)."""
    h, per_text = word_hashes(texts)
    ends = np.cumsum(per_text)
    n = max(0, len(h) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = rolled * STEP + h[k : k + n]
    rolled = _mixed(rolled + np.uint64(size))
    out = []
    for end, words in zip(ends.tolist(), per_text.tolist(), strict=True):
        start = end - words
        if words >= size:
            out.append(np.unique(rolled[start : end - size + 1]))
        elif words:
            one = np.zeros(1, np.uint64)
            for x in h[start:end]:
                one = one * STEP + x
            out.append(_mixed(one + np.uint64(words)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
