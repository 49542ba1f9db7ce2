"""Repeated passages against a comparison of all windows."""

import hashlib
import random
import re

import numpy as np

from vocabshift.llm import repeats as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, length):
    least = {}
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - length + 1 if i is not None else 0):
            key = tuple(w[k : k + length])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - length + 1 if i is not None else 0):
            if least[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, length):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, kept string, print int")
    return sorted(map(tuple, R.report(R.without_repeats(frame, length)).collect()), key=repr)


def cases(seed, length):
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(30)}" for _ in range(rng.randint(length - 1, 3 * length))] for _ in range(6)]
    docs = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [f"v{rng.randrange(1000)}" for _ in range(rng.randint(0, length))]
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            words += p[a : len(p) - rng.randrange(len(p) // 2)] if rng.random() < 0.5 else p
            if rng.random() < 0.2:
                words[rng.randrange(len(words))] = "É x"
        docs.append((rng.randrange(1000), rng.choice([" ", "\n", " \t "]).join(words)))
    docs += [(2000 + k, "a " * (length + 3 * k)) for k in range(5)] + [(2100, "a b " * 2 * length), (2101, "b a " * 2 * length)]
    docs += [(None, docs[0][1]), (1, None), (1, None), (2, ""), (3, " \t"), docs[5], docs[5], (docs[6][0], docs[7][1])]
    docs += [(3000, " ".join(passages[0] * 2)), (3001, " ".join(passages[0])), (0, "A " + docs[9][1].upper())]
    return docs


def test_random_cases(spark):
    for seed, length in ((1, 12), (2, 50)):
        docs = cases(seed, length)
        assert run(spark, docs, length) == brute(docs, length)


def test_families_of_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    docs = [(i, " ".join(base)) for i in range(100)]
    for i in range(100, 250):  # near copies that differ in one to three words
        near = list(base)
        for _ in range(rng.randint(1, 3)):
            near[rng.randrange(len(near))] = f"n{rng.randrange(3)}"
        docs.append((i, " ".join(near)))
    assert run(spark, docs, 50) == brute(docs, 50)


def test_long_texts_and_ranges(spark):
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(60)]
    filler = [[f"z{rng.randrange(10**6)}" for _ in range(60_000)] for _ in range(2)]
    docs = [(1, " ".join(filler[0] + passage)), (2, " ".join(filler[1][:40_000] + passage + filler[1][40_000:]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in R.without_repeats(frame).collect()}
    assert [tuple(x) for x in got[2]["removed"]] == [(40_000, 40_060)] and not got[1]["removed"]
    assert got[2]["kept"] == " ".join(filler[1])


def test_blocks_and_pieces_change_no_hash(monkeypatch):
    text = " ".join(f"w{k % 17}é" for k in range(5_000))
    h, counts = R.words_of([text, "a b"])
    whole = R.occurrences(h, counts, 50)
    monkeypatch.setattr(R, "PIECE_BYTES", 100)
    again, counts_again = R.words_of([text, "a b"])
    assert (again == h).all() and (counts == counts_again).all()
    monkeypatch.setattr(R, "BLOCK", 333)
    covered = lambda found: {(t, k) for t, f, n in zip(found[0], found[3], found[4]) for k in range(f, f + n)}
    cut = R.occurrences(h, counts, 50)
    assert covered(cut) == covered(whole) == {(0, k) for k in range(4_951)} and sum(cut[4]) == 4_951


def test_least_of_takes_the_last_of_equals():
    values = np.array([3, 1, 1, 2, 1, 5, 5, 5], np.uint64)
    assert R.least_of(values, 3).tolist() == [2, 2, 4, 4, 4, 7]


def test_empty_table(spark):
    assert run(spark, [], 50) == []
