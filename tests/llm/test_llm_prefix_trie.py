"""The prefix trie against one built in plain Python."""

import hashlib
import random
import zlib

import pytest

from vocabshift.llm import prefix_trie as T


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids = {n: 0 for n in nodes}
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if built[c] == n)))
        parent = min(nodes[n[:-1]]) if n else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(n), parent, len(members), kids[n], leaves[n], saved[n], digest))
    return sorted(out, key=repr)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, id string, depth int")
    return sorted(map(tuple, T.report(T.prefix_trie(frame)).collect()), key=repr)


def case(seed, deepest):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 12), *range(100, 108), *range(205, 215), 300, 400, 100_000_000_050]:
        shared = rng.random() < 0.5
        for turn in range(rng.choice([1, 2, 3, 8, deepest])):
            text = f"t{turn}" if shared and rng.random() < 0.9 else rng.choice(["", "é漢", "a", "b", "long " * 9])
            rows.append((c, turn, "user" if turn % 2 else "assistant", text))
    rows += [(5, None, None, None), (5, None, "user", None), (6, 3, "user", "a"), (6, 3, "user", "a"), (None, 1, "user", "a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("band", "block", "deepest"), [(32, 4096, 9), (3, 4, 40), (2, 1, 17)])
def test_random_cases_in_bands(spark, monkeypatch, band, block, deepest):
    monkeypatch.setattr(T, "BAND", band)
    monkeypatch.setattr(T, "BLOCK", block)
    rows = case(band, deepest)
    assert run(spark, rows) == brute(rows)


def test_depths_at_the_edges_of_bands(spark, monkeypatch):
    monkeypatch.setattr(T, "BAND", 3)
    rows = [(400 + c, k, "u", "same") for c, n in enumerate((3, 4, 9, 10, 27, 28)) for k in range(n)]
    assert run(spark, rows) == brute(rows)


def test_many_copies_of_one_conversation(spark):
    rows = [(c, k, "u", f"t{k}") for c in range(1000) for k in range(7)]
    assert run(spark, rows) == brute(rows)


def test_conversations_without_turns(spark):
    turnless = [c for c in range(601, 700) if zlib.crc32(str(c).encode()) % 6 >= 1]
    rows = [(c, 0, "u", "x") for c in turnless]  # their base is absent and their only turn is replaced
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 1 and got[0][4:6] == (0, 1)


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "u", "x")]) == []
