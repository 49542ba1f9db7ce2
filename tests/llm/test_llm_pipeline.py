"""The pipeline against the composition of brute-force stages, the registered queries against their SQL."""

import re
import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline as P  # noqa: E402
import test_llm_decontam as decontam  # noqa: E402
import test_llm_ngram_join as join  # noqa: E402
from vocabshift.llm import langid, subword  # noqa: E402
from vocabshift.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def mask(text):
    """The base kinds by their plain patterns (the added kinds do not occur in the table)."""
    from test_llm_spans import pii_base

    spans = [s.rsplit(":", 2) for s in pii_base(text).split(",") if s]
    out, upto = [], 0
    for kind, a, b in spans:
        if int(a) >= upto:
            out += [text[upto : int(a)], f"<{kind}>"]
        upto = max(upto, int(b))
    return "".join([*out, text[upto:]])


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.fit_documents(docs)
    texts = {i: r.text for i, r in rows.items()}
    kept = {i for i, t in texts.items() if not model.predict([t])[0][3]}
    groups = join.brute([(i, texts[i]) for i in sorted(kept)])
    kept = {i for i in kept if groups[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in decontam.brute([(i, texts[i]) for i in kept], items) if r[5]}
    vocabulary = subword.load()
    path = lambda t: vocabulary.best_path(subword.marked(t.replace(subword.MARK, " "))) if t else []
    want = {i: path(mask(texts[i])) for i in kept - hit}  # position by position, without the operator's words and chunks
    got = {r.doc_id: (list(r.ids), r.n_tokens) for r in P.run(spark, SF).collect()}
    assert got == {i: (ids, len(ids)) for i, ids in want.items()}
    assert 0 < len(got) < len(rows)


def test_stages_keep_the_columns_and_odd_rows(spark):
    rows = [(1, "the of and that with this", "en", "s", 5), (1, "the of and that with this", "en", "s", 5)]
    rows += [(None, "the of and that with this", None, None, None), (2, None, "en", "s", 0), (3, "", "de", "s", 0)]
    rows += [(4, "mail me at a@b.de now and then", "en", "s", 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "named_struct('a', doc_id) AS kept_rows", "array(1) AS pii")
    out = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=repr)
    text = "the of and that with this"
    assert got == sorted([(1, text, 25), (None, text, 25), (4, "mail me at <email> now and then", 31)], key=repr)
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    long, near = words(0, 60), words(0, 58) + " x y"
    rows = [(5, long), (7, near), (7, words(100, 160)), (7, words(200, 260)), (7, words(200, 260)), (9, words(200, 260))]
    rows += [(8, None), (8, ""), (8, words(300, 304)), (None, long), (None, long), (10, words(400, 460))]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, key string")
    out = P.near_duplicates(spark, docs, SF)
    assert out.schema == docs.schema
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    kept = [(5, long), (7, words(100, 160)), (8, words(300, 304)), (10, words(400, 460)), (None, long), (None, long)]
    kept += [(8, None), (8, "")]
    again = [r for r in got if r[1] == words(200, 260)]
    assert len(again) == 1  # one of its rows stays, whichever of the ids has the smaller place
    assert sorted([r for r in got if r not in again], key=repr) == sorted(kept, key=repr)


def test_one_query_for_each_operator():
    assert [re.match(r"op(\d+)_", n)[1] for n in QUERIES] == [str(i) for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[want.columns.tolist()]
    order = want.columns.tolist()
    got, want = (x.sort_values(order).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
