"""Subword encoding: against the library's best path, sequential against scanned, round trips."""

import random

import numpy as np
import pandas as pd
import pytest

from vocabshift.llm import subword as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return S.load()


def sequential(vocabulary, text):
    return vocabulary.best_path(S.marked(text.replace(S.MARK, " "))) if text else []


def odd_texts():
    rng = random.Random(1)
    return [
        "a" * 300,
        "the of and " * 60,
        "漢字かな交じり文𝒳\n" * 30,
        "  " * 200,
        "".join(rng.choice("abcdetho ") for _ in range(3000)),
        "x" * 40 + " " + "y" * 50,
        " lead and trail ",
        "a▁b ▁▁ c",
        "\t\n\r\0 \x7f",
        "!" * 500,
        "",
    ]


def test_best_paths_have_the_librarys_score(vocabulary):
    sentencepiece = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    proto.ParseFromString(open(S.MODEL_FILE, "rb").read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores, best path instead of merges
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rng = random.Random(2)
    score = lambda ids: sum(vocabulary.scores[i] for i in ids)
    for _ in range(500):
        text = "".join(rng.choice("abcdefghinorstuvw") for _ in range(rng.randint(1, 14)))
        text = " ".join([text, text[:3]]) if rng.random() < 0.3 else text
        best = library.nbest_encode_as_ids(text, 2)[0]
        assert score(best) == score(vocabulary.encode_all([text])[0])


def test_words_at_once_equal_position_by_position(vocabulary):
    texts = odd_texts()
    assert vocabulary.encode_all(texts) == [sequential(vocabulary, t) for t in texts]
    assert vocabulary.encode_all([None, "a"])[0] is None


def test_round_trip(vocabulary):
    for t in odd_texts():
        assert vocabulary.decode(vocabulary.encode_all([t])[0]) == t.replace(S.MARK, " ")


def chunk_parts(vocabulary, s, chunk):
    left = vocabulary.longest - 1
    cuts = list(S.cut(len(s), vocabulary, chunk))
    assert "".join(s[a:b] for a, b in cuts) == s
    return S.parts(vocabulary, [(s[max(0, a - left) : a], s[a:b]) for a, b in cuts])


@pytest.mark.parametrize("chunk", [17, 20, 33, 100, 1000])
def test_scan_equals_sequential(vocabulary, chunk):
    for text in odd_texts()[:-1]:
        s = S.marked(text)
        parts = chunk_parts(vocabulary, s, chunk)
        vector = np.full(vocabulary.longest, S.NEVER, np.int64)
        vector[0] = 0
        vectors = []
        for p in parts:
            vectors.append(vector)
            vector = np.maximum((vector[:, None] + S.transfer(vocabulary, p)).max(axis=0), S.NEVER)
        assert vector[0] == vocabulary.forward(s, [0])[0][-1]
        state, ids = 0, []
        for p, v in zip(reversed(parts), reversed(vectors), strict=True):
            ids.append(S.chunk_ids(vocabulary, p, v, state))
            state = int(S.back_map(vocabulary, p, v)[state])
        assert state == 0
        assert [i for p in reversed(ids) for i in p] == vocabulary.best_path(s)


@pytest.mark.parametrize("chunk", [60, 200])
def test_transfer_matrices_equal_all_paths(vocabulary, chunk):
    """Every entry against the best path of the whole chunk from its start state; words part most of these chunks."""
    width, parted = vocabulary.longest, 0
    for text in [*odd_texts()[:-1], "der Hund 漢𝒳 und die Katze " * 20]:
        s = S.marked(text)
        cuts = list(S.cut(len(s), vocabulary, chunk))
        for (a, b), p in zip(cuts, chunk_parts(vocabulary, s, chunk), strict=True):
            got, around = S.transfer(vocabulary, p), s[max(0, a - width + 1) : b]
            parted += p.mid is not None
            for i in range(width):
                if i > p.edge:
                    assert (got[i] == S.NEVER).all()
                    continue
                best = vocabulary.forward(around, [S.NEVER] * (p.edge - i) + [0] + [S.NEVER] * i)[0]
                assert got[i].tolist() == [best[len(around) - j] if j <= len(around) else S.NEVER for j in range(width)]
    assert parted > 20


def test_every_chunk_of_production_size_has_a_computed_matrix(vocabulary):
    docs = [t for t in pd.read_parquet(f"{SF}/documents.parquet")["text"].dropna() if len(t) > 200]
    s = S.marked(" ".join(docs))
    parts = chunk_parts(vocabulary, s[: 4 * S.CHUNK + 7], S.CHUNK)
    assert len(parts) >= 4
    found = [S.transfer(vocabulary, p) for p in parts]
    assert all((m[0] > S.NEVER // 2).all() and len(set(m[0].tolist())) > 1 for m in found)
    assert any((m[:, 0] > S.NEVER // 2).sum() > 1 for m in found)  # a boundary inside a word


def test_products_of_transfer_matrices_are_associative(vocabulary):
    for text in ("antidisestablishmentarianism" * 6, "the of and that with this " * 9):
        a, b, c = [S.transfer(vocabulary, p) for p in chunk_parts(vocabulary, S.marked(text), 20)][1:4]
        assert (S.combine(S.combine(a, b), c) == S.combine(a, S.combine(b, c))).all()


def test_giant_documents_on_spark(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(S, "FAN", 4)
    rows = [(i, t, "x") for i, t in enumerate([*odd_texts(), None, odd_texts()[4], "der und " * 700])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in S.encode(df, vocabulary, chunk=100).collect()}
    assert got == {i: None if t is None else sequential(vocabulary, t) for i, t, _ in rows}
    back = {r.doc_id: r.text for r in S.decode(S.encode(df, vocabulary, chunk=100), vocabulary).collect()}
    assert back == {i: None if t is None else t.replace(S.MARK, " ") for i, t, _ in rows}


def test_whole_table(spark, vocabulary):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = S.report(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert all(r.ids == sequential(vocabulary, texts[r.doc_id]) for r in got[:40])
    odd = spark.createDataFrame([(None, "a"), (1, None), (1, None), (2, "")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_tokens, r.round_trip) for r in S.report(odd).collect()), key=repr)
    assert rows == sorted([(None, 1, True), (1, None, None), (1, None, None), (2, 0, True)], key=repr)
    assert S.report(odd.limit(0)).count() == 0
