"""Language ID and toxicity: held-out quality, folds, defined cases; HTML main text on crafted pages."""

import zlib

import numpy as np
import pytest

from vocabshift.llm import html_main as H
from vocabshift.llm import langid as L
from vocabshift.llm import toxicity as X

SF = "/root/testdata/sf0.01"
LOREM = "Some longer text about things that happened today, with a comma and a full stop. " * 3


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_of_held_out_documents(spark, docs):
    got = {r.doc_id: r for r in L.report(docs).collect()}
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.lang_pred in set(want.values()) | {"und"}
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == want[i] for i in held) / len(held) > 0.97
    assert sum(r.rejected for r in got.values()) == 0


def test_language_learns_from_the_training_fold_only(spark, docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    df = spark.createDataFrame(wrong, "doc_id long, text string, lang string")
    assert "xx" not in L.fit_documents(df).languages


def test_language_defined_cases(spark, docs):
    model = L.fit_documents(docs)
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "123 !!", 0.5), (None, "the of and that with", 0.5), (5, "漢字かな交じり文", 0.5)]
    rows += [(6, "the\0of\0and", 0.5), (6, "the\0of\0and", 0.5), (7, "der und die nicht " * 30_000, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in L.identify(df, model, ("doc_id",)).collect()]
    assert got[:5] == [(1, "und", True), (2, "und", True), (3, "und", True), (None, "en", False), (5, got[4][1], True)]
    assert got[5] == got[6] == (6, "en", False) and got[7] == (7, "de", False)
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.report(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.report(unlabelled).collect()] == [("und", 0.0)]


def test_language_rejects_long_unseen_languages_and_gibberish(spark, docs):
    model = L.fit_documents(docs)
    rng = np.random.default_rng(1)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja "
    finnish += "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i "
    polish += "sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. "
    syllables = ["ka", "ik", "ki", "mi", "set", "yn", "ty", "vät", "pai", "na", "ar", "vol", "taan", "oi", "keuk", "sil", " ", "ja "]
    texts = [finnish, finnish * 100, polish, polish * 100, russian, "asdf jkl qwer zxcv hjkl uiop " * 40, draw(syllables, 9000)]
    for n in (1000, 20_000, 200_000):
        texts += [draw(map(chr, range(0x4E00, 0x9FA5)), n), draw("абвгдежзийклмнопрстуфхцчшщъыьэюя     ", n)]
        texts.append(draw("abcdefghijklmnopqrstuvwxyz     ", n))
    assert [t[:20] for t, p in zip(texts, model.predict(texts), strict=True) if not p[3]] == []

    held = [(r.lang, r.text) for r in docs.where(L.held_out()).orderBy("doc_id").collect() if r.lang and r.text]
    clean = [t[:n] for _, t in held for n in (12, 40, 150, 600, 3000)]
    for lang in sorted({lang for lang, _ in held}):
        own = [t for x, t in held if x == lang]
        clean += [" ".join(own), *[" ".join(own[i : i + 8]) for i in range(0, len(own), 8)]]
    lost = [p[3] and any(c.isalpha() for c in t) for t, p in zip(clean, model.predict(clean), strict=True)]
    assert np.mean(lost) < 0.002


def test_language_rejection_needs_members(spark):
    rows = [(i, "the of and that with this", "en") for i in range(300)]
    model = L.fit_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert not model.predict(["mail me now and then"])[0][3] and model.predict(["漢字かな交じり文"])[0][3]


def test_gram_counts_do_not_depend_on_the_batch():
    texts = ["Hello, World!", None, "", "a", "  ß é  ", "x\0y", "İstanbul"]
    together, has = L.gram_counts(texts)
    alone = [L.gram_counts([t]) for t in texts]
    assert all((together[i] == c[0]).all() and has[i] == h[0] for i, (c, h) in enumerate(alone))


def test_toxicity_of_held_out_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in X.report(docs, labels).collect()}
    assert len(got) == docs.count()
    y = {r.doc_id: r.toxic for r in labels.collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert all(0 <= o.start < o.end for o in r.offending)
    a = np.array([got[i].score for i in y if got[i].held_out and y[i] == 1])
    b = np.array([got[i].score for i in y if got[i].held_out and y[i] == 0])
    assert ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2) > 0.85
    assert np.mean(b < 0.5) > 0.95


def test_toxicity_never_learns_held_out_labels(spark):
    words = ["apple", "pear", "plum", "fig"]
    rows = [(i, f"{words[i % 4]} {words[i % 3]} tree. " + ("vile" if i % 2 else "nice")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, (i % 2) ^ (zlib.crc32(str(i).encode()) % 5 == 0)) for i, _ in rows]
    labels = spark.createDataFrame([(i, int(y)) for i, y in flipped], "doc_id long, toxic int")
    got = X.report(docs, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)
    offending = next(r for r in got if r.doc_id == 3)
    text = dict(rows)[3]
    assert [text[o.start : o.end].strip() for o in offending.offending] == ["vile"]


def test_toxicity_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (3, "b"), (3, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    got = X.report(docs, labels).collect()
    assert [(r.doc_id, r.score, r.predicted) for r in got] == [(1, 0.0, 0), (2, 0.0, 0), (None, 0.0, 0), (3, 0.0, 0), (3, 0.0, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert X.report(empty, labels).count() == 0


def test_sentence_ranges():
    words, where, ranges = X.read_text("One two! Three.\n\nfour")
    assert words == ["one", "two", "three", "four"] and where.tolist() == [0, 0, 1, 2]
    assert ranges == [(0, 8), (8, 17), (17, 21)]


@pytest.fixture(scope="module")
def page_model(spark):
    return H.fit(H.sampled(spark.read.parquet(f"{SF}/pages.parquet"), 100))


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<nav><a href=x>m</a></nav><article><h1>T</h1><p>{LOREM}</article><footer>f</footer>", f"T {LOREM.strip()}"),
        ("<article><p>x<p title='a>b'>y<script>if(a<b)'</p>'</script>z<style>p{}</style></article>", "x y z"),
        (f"<article><header>H</header><p>{LOREM}<form><p>q</form><div class='comments'><p>{LOREM}</div><p>end</article>", f"{LOREM.strip()} end"),
        ("<article><p>a&nbsp;b &lt;i&gt; &#233;&amp;&amp 1 < 2 <3\n\t c<br>d<b>e</b>f</article>", "a b <i> é&& 1 < 2 <3 c def"),
        ("<article><p>cut off <b", "cut off"),
        ("<article><!-- x --><p>a<!-- never closed <p>b", "a"),
        ("<main><div class='ad'>buy</div><p>one</p><aside>no</aside></main>", "one"),
        ("", ""),
    ],
)
def test_main_text(page_model, body, want):
    assert page_model.extract(page(body)) == want


def test_main_text_without_article_markup(page_model):
    body = f"<div class=nav><a href=x>a</a></div><div><h1>Title</h1><p>{LOREM}<p>{LOREM}</div><div id=comments><p>{LOREM}</div>"
    assert page_model.extract(page(body)) == " ".join(["Title", LOREM.strip(), LOREM.strip()])


@pytest.mark.parametrize("opening", ["<div id=comments>", "<aside>", "<footer>", "<div id=comments><div>", "<div class='comment-list'>"])
def test_many_paragraphs_do_not_outvote_a_name(page_model, opening):
    article = f"<div><h1>Title</h1><p>{LOREM}<p>{LOREM}</div>"
    want = " ".join(["Title", LOREM.strip(), LOREM.strip()])
    for n in (1, 30):
        assert page_model.extract(page(article + opening + f"<p>Reply. {LOREM}</p>" * n)) == want


@pytest.mark.parametrize("name", ["post has-sidebar", "with-comments", "entry no-sidebar"])
def test_modifiers_do_not_name_the_element(page_model, name):
    want = f"T {LOREM.strip()}"
    assert page_model.extract(page(f"<article class='{name}'><h1>T</h1><p>{LOREM}</article>")) == want
    assert page_model.extract(page(f"<div class='{name}'><h1>T</h1><p>{LOREM}<p>{LOREM}</div>")) == f"{want} {LOREM.strip()}"


LISTED_INSIDE = (
    "post category-search", "post tag-newsletter", "post category-advertising hentry", "post sidebar-none", "content header-image",
    "post notice-board", "page reply-letter",
)


@pytest.mark.parametrize("name", LISTED_INSIDE)
def test_listed_words_inside_longer_names_take_no_article(page_model, name):
    want = " ".join(["T", LOREM.strip(), LOREM.strip()])
    for tag in ("article", "div"):
        assert page_model.extract(page(f"<{tag} class='{name}'><h1>T</h1><p>{LOREM}<p>{LOREM}</{tag}>")) == want
    inner = f"<article><h1>T</h1><section id='related-work'><p>{LOREM}<p>{LOREM}</section></article>"
    assert page_model.extract(page(inner)) == want


def test_names_never_take_an_article_element(page_model):
    assert page_model.extract(page(f"<article class='header'><h1>T</h1><p>{LOREM}<p>{LOREM}</article>")).endswith(LOREM.strip())


def test_copies_count_once_in_the_sample(spark):
    rows = [(f"<article><p>{i % 3}</article>",) for i in range(300)]
    assert len(H.sampled(spark.createDataFrame(rows, "html string"), 100)) == 3


def test_marginals_are_those_of_all_states(page_model):
    source = page(f"<div><p>{LOREM}</p><ul><li>a</li></ul></div><div><p>x</div>")
    p = H.Page(source)
    n = len(p.tag)
    unary = [page_model.bias + sum(page_model.weights.get(f, 0.0) for f in fs) for fs in p.features()]
    weight = np.zeros((n, 2))
    for state in range(2**n):
        s = [state >> i & 1 for i in range(n)]
        value = np.exp(sum(u for u, on in zip(unary, s, strict=True) if on))
        for i in range(1, n):
            value *= page_model.edges[p.tag[i] in H.CONTAINER][s[p.parent[i]]][s[i]]
        for i in range(n):
            weight[i, s[i]] += value
    assert page_model.content(p) == (weight[:, 1] > weight[:, 0]).tolist()


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = H.report(pages).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in got)
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "y"), (2, "u", "", "y")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in H.report(odd).collect()] == [(1, None, "", 0), (2, "u", "", 0), (2, "u", "", 0)]
    assert H.report(odd.limit(0)).count() == 0


def test_deep_and_long_pages(page_model):
    assert page_model.extract("<article>" + "<div>" * 3000 + "<p>deep") == "deep"
    assert page_model.extract("<" * 20_000) is not None
    assert page_model.extract("<article><p>" + "a<b x='" * 3000) is not None
