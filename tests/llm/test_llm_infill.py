"""Fill-in-middle forms against a plain slicing of each text."""

import hashlib
import random

import numpy as np

from vocabshift.llm import infill as I

P, S, M = I.MARKERS


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    digits = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in I.MARKERS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, S + suffix + P + prefix + M + middle
    return doc_id, n, "psm", a, b - a, P + prefix + S + suffix + M + middle


def texts():
    rng = random.Random(5)
    letters = "ab c<>PSM.\né漢😀"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    shared = "".join(rng.choice("abc é漢😀\n") for _ in range(30_000))
    made += [shared, "x" + shared, shared + "y", shared[5000:], "z" * 50_000, "é" * 20_000, "<P" * 9_000]
    made += [shared[:k] + "<M>" + shared[k:] for k in (0, 511, 512, 2047, 30_000)]
    return [None, "", "a", "é", "<P>", "<S", *made]


def test_equal_to_slicing_with_clashing_columns(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "null id", "x", 1), (3, "a", "x", 1), (3, "a", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    made = I.fill_in_middle(docs, keep=("doc_id",)).collect()
    want = [brute(i, t) for i, t, *_ in rows]
    assert sorted(map(tuple, made), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    back = {(r[0], r[1]) for r in I.report(I.fill_in_middle(docs)).select("doc_id", "restored_sha256").collect()}
    assert back == {(i, sha(t or "")) for i, t, *_ in rows}


def test_small_memory_and_other_markers_change_nothing(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    whole = sorted(map(tuple, I.fill_in_middle(docs).collect()))
    assert sorted(map(tuple, I.fill_in_middle(docs, cache_bytes=1_000).collect())) == whole
    other = I.fill_in_middle(docs, markers=("[pre]", "[suf]", "[mid]"), plain_percent=0, spm_percent=50)
    again = other.select("doc_id", I.restored(other["output"], other["form"], ("[pre]", "[suf]", "[mid]")).alias("t"))
    assert dict(again.collect()) == {i: t or "" for i, t in enumerate(texts())}


def test_chunks_depend_on_content_and_are_remembered():
    rng = random.Random(1)
    shared = bytes(rng.randrange(256) for _ in range(200_000))
    summaries = I.Summaries(I.MARKERS)
    for lead in (b"", b"other start " * 100):
        raw = lead + shared
        ends = I.chunk_ends(I._marks(np.frombuffer(raw, np.uint8)).tolist(), 0, len(raw))
        cuts = [0, *ends]
        assert ends[-1] == len(raw) and all(y - x <= I.MOST for x, y in zip(cuts, ends))
        summaries.combined([raw[x:y] for x, y in zip(cuts, ends)])
    assert summaries.hits > 0.8 * summaries.misses


def test_rolling_hash_is_the_same_over_blocks(monkeypatch):
    data = np.frombuffer(random.Random(2).randbytes(100_000), np.uint8)
    whole = I._marks(data).tolist()
    monkeypatch.setattr(I, "BLOCK", 777)
    assert I._marks(data).tolist() == whole


def test_markers_across_chunks():
    summaries = I.Summaries(I.MARKERS)
    assert summaries.combined([b"ab<", b"S", b">c"]) == ([3, 4, 6], True)
    assert summaries.combined([b"ab<", b"S", b" >c"])[1] is False


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert I.report(I.fill_in_middle(empty)).collect() == []
