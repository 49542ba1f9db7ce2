"""N-gram Jaccard join: against all pairs, on random families of near copies, and in its parts."""

import random
import re
from types import SimpleNamespace

import numpy as np
import pytest

from vocabshift.llm import common
from vocabshift.llm import ngram_join as J
from vocabshift.llm.components import components
from vocabshift.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, n_shingles string"


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    """(id -> (set size, component)) by all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.report(df).collect()}


def family(rng, words, size, edits):
    """A chain of texts, each a few edits away from an earlier one."""
    texts = [[rng.choice(words) for _ in range(rng.randint(20, 60))]]
    for _ in range(size - 1):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[rng.choice(words)], [], [t[k], rng.choice(words)]])
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_families(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = []
    for _ in range(12):
        texts += family(rng, words, rng.randint(1, 14), 3)
    texts += [f"{passage} {t}" for t in family(rng, words, 12, 6)]
    texts += [f"{passage} {rng.choice(words)} {rng.choice(words)}" for _ in range(15)]
    texts += [texts[0]] * 5 + [texts[3].upper()] * 2
    rng.shuffle(texts)
    rows = [(7 * i + 3, t) for i, t in enumerate(texts)]
    assert found(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "é " * 9), (8, "É " * 9)]
    rows += [(9, "x " * 50_000), (10, "x " * 10), (11, "a b c d e f"), (12, "a b c d e f")]
    got = found(spark, rows)
    assert got == brute(rows)
    assert got[5] == (1, 4) and got[1] == (0, 1) and got[9] == (1, 9) and got[10] == (1, 9)
    assert found(spark, []) == {}
    null_id = J.report(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in null_id.collect()} == {(None, None), (3, 3)}


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")] * 3 + [(2, "q")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.report(df).collect())
    assert got == [(1, 3, 1)] * 3 + [(2, 1, 2)]


def test_prefix_size_covers_every_link():
    for n in range(1, 400):
        least = -(-J.PERCENT * n // 100)
        assert J.prefix_size(n) == n - least + 1


def test_shingles_of_many_texts_at_once():
    texts = ["a b c d e f", None, "one two", "", "A B c D e F", "a b c d e f g"]
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 0, 1, 0, 2, 3]
    assert (sets[0] == sets[4]).all() and set(sets[0].tolist()) < set(sets[5].tolist())
    alone = [shingle_sets([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(sets, alone, strict=True))


def test_first_pairs_cover_short_lists_and_star_long_ones():
    p = np.zeros(9, J.POSTING)
    p["token"] = [1, 1, 1, 2, 2, 2, 2, 2, 3]
    p["gid"] = [10, 11, 12, 20, 21, 22, 23, 24, 30]
    p["n"] = 100
    got = {tuple(x) for x in J.first_pairs(p).to_numpy().tolist()}
    assert got == {(10, 11), (10, 12), (11, 12), (20, 21), (20, 22), (20, 23), (20, 24)}
    assert set(J.long_lists(p)["gid"].tolist()) == {20, 21, 22, 23, 24}


def test_second_pairs_skip_what_is_connected():
    p = np.zeros(5, J.LABELLED)
    p["token"], p["gid"], p["n"] = 1, [1, 2, 3, 4, 5], 50
    p["label"] = [1, 1, 1, 4, 5]
    got = {tuple(x) for x in J.second_pairs(p).to_numpy().tolist()}
    assert got == {(1, 4), (2, 4), (3, 4), (1, 5), (2, 5), (3, 5), (4, 5)}
    p["label"] = 1
    assert J.second_pairs(p).empty


def test_packed_postings_come_back():
    p = np.zeros(5, J.POSTING)
    p["gid"], p["n"], p["token"], p["pos"] = [7, 7, 9, 9, 9], [5, 5, 6, 6, 6], [1, 2, 2**32 - 1, 3, 4], [0, 1, 2, 3, J.FAR]
    assert (J.unpacked(J.packed(p)) == p).all()
    tokens = np.array([1, 2**48 - 1, 77], np.uint64)
    assert (J._tokens(tokens.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()) == tokens).all()


def test_prefix_bound_never_lies_below_the_intersection():
    rng = random.Random(7)
    for _ in range(2000):
        pool = rng.sample(range(10_000), 80)
        late = set(rng.sample(pool, rng.choice([0, 5, 30])))
        order = lambda v: (v in late, v)  # noqa: E731, B023
        x, y = (sorted(rng.sample(pool, rng.randint(5, 70)), key=order) for _ in range(2))
        px, py = x[: J.prefix_size(len(x))], y[: J.prefix_size(len(y))]
        args = [(np.array(p, np.uint64), n, int(p[-1] in late)) for p, n in ((px, len(x)), (py, len(y)))]
        # frequent tokens inside a prefix that does not end in one cannot be
        assert J.most_common(*args[0], *args[1]) >= len(set(x) & set(y))


def test_decisions_near_the_threshold_are_left_to_64_bits():
    assert [J.decide(90, 90, c, 64) for c in (79, 80)] == [0, 1]
    assert J.decide(90, 90, 80, 32) == 2 and J.decide(900, 900, 900, 32) == 1 and J.decide(900, 900, 700, 32) == 0


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 150)]
    links = spark.createDataFrame(path + star + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 150)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_of_one_text_that_seldom_link(spark):
    rng = random.Random(8)
    base = [f"b{rng.randrange(60)}" for _ in range(150)]
    rows = []
    for i in range(160):
        t = list(base)
        for k in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 5])):
            t[k] = f"e{rng.randrange(4000)}"  # prefixes differ, most pairs stay below the similarity
        rows.append((i * 3 + 1, " ".join(t)))
    want = brute(rows)
    assert len({c for _, c in want.values()}) > 3
    assert found(spark, rows) == want


def test_marks_never_exclude_a_link():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 63, rng.integers(5, 1500)).astype(np.uint64))
        for cut in (0, 0.03, 0.1, 0.2, 0.4):
            keep = rng.random(len(base)) >= cut
            sets.append(np.unique(np.append(base[keep], rng.integers(0, 1 << 63, int(cut * len(base))).astype(np.uint64))))
    n = np.array([len(s) for s in sets])
    marks = np.frombuffer(b"".join(map(J._mark, sets)), np.uint64).reshape(len(sets), -1)
    a, b = np.triu_indices(len(sets), 1)
    near = J.near_by_marks(marks, n, a, b)
    excluded = 0
    for x, y, kept in zip(a, b, near):
        common = len(np.intersect1d(sets[x], sets[y]))
        links = 100 * common >= 80 * (n[x] + n[y] - common)
        assert kept or not links
        excluded += not kept
    assert excluded > len(a) // 2
    none = np.concatenate([marks[:2], np.frombuffer(J.NO_MARK, np.uint64)[None]])
    assert J.near_by_marks(none, np.array([9, 9, 9]), np.array([0]), np.array([2])).all()  # an unknown mark excludes nothing


def test_other_members_of_short_lists_link(spark):
    """1 and 2 share size and prefix and do not link; 3, of another prefix, links with 2 alone, by shingles that nothing else has."""
    head = [f"h{k}" for k in range(30)]
    tails = [[f"t{s}x{k}" for k in range(8)] for s in (1, 2)]
    texts = [head + tails[0], head + tails[1], ["other", *head[1:], *tails[1]]]
    for s, tail in enumerate(tails):  # what differs is frequent, and so last in the order
        texts += [head[-4:] + tail + [f"own{s}x{k}x{j}" for j in range(60)] for k in range(6)]
    rows = list(enumerate(map(" ".join, texts), 1))
    got = found(spark, rows)
    assert got == brute(rows)
    assert (got[1][1], got[2][1], got[3][1]) == (1, 2, 2)


def test_groups_that_share_an_id_keep_their_sizes():
    p = np.zeros(5, J.POSTING)
    p["token"], p["gid"], p["n"], p["pos"] = [1, 2, 3, 4, 5], [7, 7, 7, 7, 9], [10, 10, 40, 40, 12], [0, 1, 0, 1, 0]
    assert J.unpacked(J.packed(p)).tolist() == p.tolist()


def test_second_candidates_become_rows_once(spark):
    """Two groups of near sets in eight lists, each in a bucket of its own, are one row; an id with two sets meets everywhere."""
    rows = [(k, 7, gid, 100, k, gid) for k in range(8) for gid in (1, 2, 3)]
    live = spark.createDataFrame(rows, "bucket int, token long, gid long, n int, pos int, label long")
    mark = bytearray(J._mark(np.arange(100, dtype=np.uint64) << np.uint64(20)))
    feats = [(1, 100, 1, 1, mark), (2, 100, 2, 2, mark), (3, 100, 3, 3, mark), (3, 100, 4, 4, mark)]
    feats = spark.createDataFrame(feats, "doc_id long, n long, f1 long, f2 long, mark binary")
    members = spark.createDataFrame([(g, g) for g in (1, 2, 3)], "gid long, node long")
    kept, real = [], J._pairs_of
    J._pairs_of = lambda *args: kept.append(real(*args)) or kept[-1]
    try:
        got = {tuple(r) for r in J.second_candidates(live, members, feats).collect()}
    finally:
        J._pairs_of = real
    assert got == {(1, 2), (1, 3), (2, 3)}
    made = [tuple(r) for r in kept[0].collect()]
    assert made.count((1, 2)) == 1 and made.count((1, 3)) == 8


def test_pairs_that_failed_in_an_earlier_list_meet_in_a_later_one():
    assert J.met_before({5: 3}, 100, {5: 9}, 100) and not J.met_before({5: 3}, 100, {5: 12}, 100)
    assert not J.met_before({5: 3}, 100, {6: 3}, 100) and J.met_before({5: J.FAR}, 100, {5: 0}, 100)


def test_a_half_filled_driver_is_told():
    class Runtime:
        totalMemory, freeMemory, maxMemory = (lambda self: 700), (lambda self: 300), (lambda self: self.most)

    runtime = Runtime()
    spark = SimpleNamespace(sparkContext=SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime))))))
    runtime.most = 700
    assert common.heap_filled(spark)
    runtime.most = 1000
    assert not common.heap_filled(spark)
