"""Exact top-k search against brute force."""

import math
import random

import numpy as np

from vocabshift.llm import topk as T


def brute(rows, k=5):
    usable = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        e = (i, tuple(math.floor(256 * float(x)) for x in v))
        if e not in usable:
            usable.append(e)
    out = set()
    for qi, q in usable:
        if qi % 50:
            continue
        scored = {(-sum(a * b for a, b in zip(q, c, strict=False)), ci) for ci, c in usable if ci != qi}
        out |= {(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(sorted(scored)[:k])}
    return out


def found(spark, rows):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, score string")
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in T.report(df).collect()}


def vectors(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * np.exp(rng.normal(size=(n, 1)) * spread)
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


def test_random_vectors(spark, monkeypatch):
    monkeypatch.setattr(T, "SEED_ROWS", 32)
    for seed, spread in ((1, 0.05), (2, 1.5)):
        rows = vectors(seed, 400, 6, spread)
        assert found(spark, rows) == brute(rows)


def test_one_direction_uses_coordinate_pruning(spark, monkeypatch):
    monkeypatch.setattr(T, "SEED_ROWS", 8)
    rng = random.Random(5)
    rows = [(i, [1.0 + rng.random() / 8, rng.random() / 8, rng.random() / 8]) for i in range(200)]
    rows += [(i, [rng.random() / 2, rng.random(), -rng.random()]) for i in range(200, 400)]
    assert found(spark, rows) == brute(rows)


def test_mask_never_drops_a_candidate_that_reaches_theta():
    rng = np.random.default_rng(3)
    q, c = rng.integers(-300, 300, (40, 5)), rng.integers(-300, 300, (200, 5))
    scores = q @ c.T
    theta = np.sort(scores, axis=1)[:, -5].astype(float)
    mask = T.candidate_mask(q, c, theta)
    assert mask[scores >= theta[:, None]].all() and mask.mean() < 0.9


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0])]
    rows += [(5, []), (6, [0.0, 0.0]), (7, [3.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [-1.0, 0.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == set()
    assert found(spark, [(1, [1.0])]) == set()
    assert found(spark, [(0, [1.0])]) == set()


def test_hot_vector(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)] + [(1000 + i, [0.5, i / 100]) for i in range(100)]
    assert found(spark, rows) == brute(rows)


def test_huge_components_are_held(spark):
    got = found(spark, [(0, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [1.0, 0.0])])
    assert (0, 1, 1, 2**63 - 1) in got
