"""Decontamination against a plain scan of all positions."""

import hashlib
import random
import re

from vocabshift.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    patterns = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w and item is not None else 0):
            patterns.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                p = tuple(w[k : k + m])
                if p in patterns:
                    hit.update(range(k, k + m))
                    found |= patterns[p]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, per_pass=D.PATTERNS_PER_PASS):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, pattern string")
    rows = D.report(D.contamination(d, b, patterns_per_pass=per_pass)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "É", "x1", "The"]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(f"i{k}", make(rng.choice([0, 1, 2, 3, 9, 10, 11, 30]))) for k in range(30)]
    items = [x for x in items if len(words(x[1])) != 1 or seed % 2]
    items += [("i5", make(12)), (None, make(12)), ("n", None)]
    docs = [(k, make(rng.randint(0, 60))) for k in range(40)]
    docs += [(100 + k, f"{make(5)} {items[k][1]} {make(5)}") for k in range(20)]
    return docs + [(None, items[0][1]), (7, None), (7, None), (8, "")], items


def test_random_cases(spark):
    for seed in (1, 2):
        docs, items = case(seed)
        assert run(spark, docs, items) == brute(docs, items)


def test_many_passes_find_the_same(spark):
    docs, items = case(3)
    assert run(spark, docs, items, per_pass=40) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = case(4)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_whole_items_are_found_in_long_texts(spark):
    rng = random.Random(9)
    item = " ".join(f"q{rng.randrange(50)}" for _ in range(40))
    filler = [" ".join(f"z{rng.randrange(5000)}" for _ in range(30_000)) for _ in range(2)]
    got = run(spark, [(1, f"{filler[0]} {item} {filler[1]}"), (2, filler[0])], [("i", item)])
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 40, 1), (2, 0, 0)]
