"""Main text of web pages by a tree-structured graphical model over the block elements.

Every block element of a page is a node with two states, *content* and *other*.  A node's own potential comes
from its tag, the words of its class, id and role, and the length, link share and ending of its own text; an
edge's potential couples a parent with a child and depends on whether the child is a container or a text
element.  Sum-product messages pass from the leaves to the root and back, which gives the exact marginal of
every node; text of nodes with a content marginal over one half is the main text.

*Training* uses a bounded sample of pages whose markup names their article (``<article>`` or ``<main>``): a node is
content if it lies in it, with no element in between, or itself, that is named as something else.  Each page is
used twice, once with the naming element turned into a plain ``div``, so the text features carry pages without
such markup.  Own potentials are logistic weights (maximum a posteriori; words of ``OTHER`` have a negative prior
mean), edge potentials are the smoothed ratio of joint to independent frequencies.

*Names*: an element with a tag of ``OTHER_TAGS``, or whose class, id or role holds a whole name that is a word of ``OTHER`` or one of
``OTHER_NAMES``, is observed as other, whatever it holds, and so is all in it down to an ``<article>`` or ``<main>`` (a ``<form>`` or
``<header>``, which may hold a whole page, only itself).  ``<article>`` and ``<main>`` are never observed.  Such a word inside a longer
name ("category-search"), or on ``<body>``, is a learned feature.  A name with a word of
``MODIFIERS`` ("has-sidebar") says nothing about the element itself; its words are features of their own.

Defined cases: null or empty html, and pages without content, give an empty text; markup that never closes
is read to its end; comments, scripts and styles are never text; without any labelled page the priors decide;
each input row gives one output row; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabshift.llm.common import map_rows, text_slices

SAMPLE_PAGES = 400
PRIOR_OTHER = -4.0
PRIOR_ARTICLE = 4.0
SMOOTHING = 0.5
STEPS = 300
SLICE_BYTES, SLICE_ROWS = 4_000_000, 1_024

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes noembed xmp template svg".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var".split()
)
CONTAINER = frozenset("html body article main section div td table tbody tr center details figure".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
SCOPE = frozenset("ul ol dl table body article main section div nav aside footer header form".split())
OTHER_TAGS = frozenset("head nav footer aside form header menu button select dialog".split())
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs header footer masthead comment comments reply replies disqus cookie cookies "
    "consent notice notices popup modal overlay subscribe newsletter signup login share sharing social related "
    "recommended widget complementary contentinfo search toolbar pagination pager".split()
)
#: Whole names of several words that say other; any other name of several words is only a learned feature.
OTHER_NAMES = frozenset(
    "ad-banner ad-container ad-slot ad-unit ad-wrapper comment-area comment-form comment-list comment-section comment-thread "
    "comments-area comments-list comments-section comments-wrapper cookie-banner cookie-bar cookie-consent cookie-notice "
    "footer-nav main-menu main-nav main-navigation nav-bar nav-menu newsletter-form newsletter-signup page-footer related-articles "
    "related-content related-posts share-bar share-buttons sharing-buttons side-bar site-footer site-header site-nav "
    "site-navigation social-links social-share top-bar top-nav user-comments widget-area".split()
)
OPEN_TAGS = frozenset("form header".split())
MODIFIERS = frozenset("has have with without no not is show hide enable enabled disable disabled".split())
NEVER = frozenset(("article", "main"))  # no name says other of these
NAME = re.compile(r"[a-z][^\s/>]*", re.I)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z]+")


class Page:
    """Block elements in document order, and text pieces (node, text, in a link) with ``None`` between blocks."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.names: list[frozenset[str]] = [frozenset()]
        self.named: list[int] = [0]  # whether names say other: not (0), in part (1), as a whole (2)
        self.pieces: list[tuple[int, str, bool] | None] = []
        self._read(source)

    def _read(self, s: str) -> None:
        open_nodes = [0]
        links = 0
        pos, n = 0, len(s)
        while pos < n:
            lt = s.find("<", pos)
            text_to = n if lt < 0 else lt
            if lt >= 0 and not (lt + 1 < n and (s[lt + 1].isalpha() and s[lt + 1].isascii() or s[lt + 1] in "/!?")):
                text_to = lt + 1  # a lone < is text
            if text_to > pos:
                self.pieces.append((open_nodes[-1], s[pos:text_to], links > 0))
            if lt < 0:
                return
            if text_to > lt:
                pos = text_to
                continue
            if s.startswith("<!--", lt):
                end = s.find("-->", lt + 4)
                pos = n if end < 0 else end + 3
                continue
            gt = _tag_end(s, lt)
            if gt < 0:
                return  # a tag cut off by the end of the page
            pos = gt + 1
            closing = s[lt + 1] == "/"
            m = NAME.match(s, lt + 1 + closing)
            if s[lt + 1] in "!?" or not m:
                continue
            tag = m[0].lower()
            if closing:
                if tag == "a":
                    links = max(0, links - 1)
                elif tag not in INLINE:
                    self._close(tag, open_nodes)
                continue
            if tag in RAW:
                pos = _after_raw(s, pos, tag)
                self.pieces.append(None)
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    self.pieces.append(None)
                continue
            if tag in INLINE:
                links += tag == "a"
                continue
            self._open(tag, s[m.end() : gt], open_nodes)

    def _open(self, tag: str, attributes: str, open_nodes: list[int]) -> None:
        self.pieces.append(None)
        if self.tag[open_nodes[-1]] in CLOSED_BY_BLOCK:
            open_nodes.pop()
        for k in range(len(open_nodes) - 1, 0, -1):
            name = self.tag[open_nodes[k]]
            if name in SIBLINGS.get(tag, ()):
                del open_nodes[k:]
                break
            if name in SCOPE:
                break
        names: set[str] = set()
        named = 2 if tag in OTHER_TAGS else 0
        if "=" in attributes:
            for found in ATTRIBUTE.finditer(attributes):
                for name in (found[2] or found[3] or found[4] or "").lower().split():
                    words = WORDS.findall(name)
                    if not MODIFIERS.isdisjoint(words):
                        names.update(f"m:{w}" for w in words)
                        continue
                    whole = len(words) == 1
                    names.update(f"{'c' if whole else 'w'}:{w}" for w in words)
                    if tag not in NEVER and not OTHER.isdisjoint(words):
                        sure = whole or "-".join(words) in OTHER_NAMES
                        named = max(named, 2 if sure and tag not in ("html", "body") else 1)
        self.named.append(named)
        self.parent.append(open_nodes[-1])
        self.tag.append(tag)
        self.names.append(frozenset(names))
        open_nodes.append(len(self.tag) - 1)

    def _close(self, tag: str, open_nodes: list[int]) -> None:
        self.pieces.append(None)
        for k in range(len(open_nodes) - 1, 0, -1):
            if self.tag[open_nodes[k]] == tag:
                del open_nodes[k:]
                return
            if tag == "p" and self.tag[open_nodes[k]] in SCOPE:
                return

    def own_text(self) -> tuple[list[int], list[int], list[str]]:
        """Per node the characters of its own text, those inside links, and its last character."""
        size, linked, last = [0] * len(self.tag), [0] * len(self.tag), [""] * len(self.tag)
        for piece in self.pieces:
            if piece is None:
                continue
            node, text, link = piece
            text = text.strip()
            if text:
                size[node] += len(text)
                linked[node] += len(text) if link else 0
                last[node] = text[-1]
        return size, linked, last

    def features(self) -> list[list[str]]:
        """Names of the features of every node."""
        size, linked, last = self.own_text()
        out = []
        for i, tag in enumerate(self.tag):
            f = [f"t:{tag}", f"l:{min(6, (size[i].bit_length() + 1) // 2)}"]
            f += self.names[i]
            if size[i]:
                f.append(f"a:{4 * linked[i] // size[i]}")
                f.append("e:1" if last[i] in ".!?:;…\"'»”" else "e:0")
            out.append(f)
        return out

    def text_of(self, chosen: list[bool]) -> str:
        """The text of the chosen nodes: one space inside and between blocks."""
        blocks: list[str] = []
        run: list[str] = []
        for piece in [*self.pieces, None]:
            if piece is None:
                if run:
                    blocks.append(" ".join("".join(run).split()))
                run = []
            elif chosen[piece[0]]:
                run.append(html.unescape(piece[1]))
        return " ".join(b for b in blocks if b)


def _tag_end(s: str, lt: int) -> int:
    """Index of the ``>`` that ends the tag at ``lt`` (quoted values may hold one), or -1."""
    gt = s.find(">", lt)
    if gt < 0:
        return -1
    at = lt
    while True:
        q = s.find("=", at, gt)
        if q < 0:
            return gt
        at = q + 1
        while at < gt and s[at] in " \t\n\r\f":
            at += 1
        if at < gt and s[at] in "\"'":
            end = s.find(s[at], at + 1)
            if end < 0:
                return gt  # a quote that never closes
            at = end + 1
            if end > gt:
                gt = s.find(">", end)
                if gt < 0:
                    return -1


def _after_raw(s: str, pos: int, tag: str) -> int:
    """Where the raw element that was opened before ``pos`` ends."""
    m = re.compile(rf"</{tag}\s*>|</{tag}(?=[\s/>])[^>]*>", re.I).search(s, pos)
    return m.end() if m else len(s)


def observed_other(page: Page) -> list[bool]:
    """Whether markup says of every node that it is, or lies in, something other than content."""
    out, inner = [], []
    for i, tag in enumerate(page.tag):
        held = i > 0 and inner[page.parent[i]] and tag not in ("article", "main")
        out.append(held or page.named[i] == 2)
        inner.append(held or (page.named[i] == 2 and tag not in OPEN_TAGS))
    return out


def labels(page: Page) -> list[int] | None:
    """Content (1) or other (0) of every node by the page's own naming; None if it names no article."""
    state = [0] * len(page.tag)
    for i, tag in enumerate(page.tag):
        if page.named[i]:
            continue
        if tag in ("article", "main") or (i and state[page.parent[i]]):
            state[i] = 1
    return state if any(state) else None


@dataclass
class Model:
    """Feature weights, bias, and edge potentials by child kind: [container][parent state][child state]."""

    weights: dict[str, float]
    bias: float
    edges: list[list[list[float]]]

    def content(self, page: Page) -> list[bool]:
        """Whether each node's content marginal is over one half (sum-product, two passes)."""
        get = self.weights.get
        n = len(page.tag)
        named = observed_other(page)
        score = []
        for i, names in enumerate(page.features()):
            u = self.bias + sum(get(f, 0.0) for f in names)
            score.append(0.0 if named[i] else math.exp(max(-60.0, min(60.0, u))))
        kind = [self.edges[tag in CONTAINER] for tag in page.tag]
        up = score[:]  # odds of content from the node and all below it
        message = [1.0] * n
        for i in range(n - 1, 0, -1):
            if named[i]:
                continue  # its name says what it is, whatever its parent is: no message either way
            e, odds = kind[i], up[i]
            message[i] = (e[1][0] + e[1][1] * odds) / (e[0][0] + e[0][1] * odds)
            if not named[page.parent[i]]:
                up[page.parent[i]] = min(max(up[page.parent[i]] * message[i], 1e-250), 1e250)
        full = up[:]
        for i in range(1, n):
            if named[i]:
                continue
            e = kind[i]
            above = full[page.parent[i]] / message[i]  # the parent's odds without this child's message
            full[i] = min(max(up[i] * (e[0][1] + e[1][1] * above) / (e[0][0] + e[1][0] * above), 1e-250), 1e250)
        return [odds > 1.0 for odds in full]

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        return page.text_of(self.content(page))


def fit(sources: list[str]) -> Model:
    """A model from labelled pages (those that name no article are left out)."""
    feats: list[list[str]] = []
    target: list[int] = []
    joint = [[[SMOOTHING] * 2 for _ in range(2)] for _ in range(2)]
    for source in sources:
        page = Page(source)
        state = labels(page)
        if state is None:
            continue
        for hide in (False, True):
            if hide:
                page.tag = ["div" if t in ("article", "main") else t for t in page.tag]
            for i, names in enumerate(page.features()):
                if page.named[i] == 2:
                    continue  # observed
                feats.append(names)
                target.append(state[i])
        for i in range(1, len(page.tag)):
            if page.named[i] == 2:
                continue
            joint[page.tag[i] in CONTAINER][state[page.parent[i]]][state[i]] += 1
    edges = []
    for table in joint:
        total = sum(map(sum, table))
        rows, cols = [sum(r) for r in table], [sum(c) for c in zip(*table, strict=True)]
        edges.append([[table[p][c] * total / (rows[p] * cols[c]) for c in range(2)] for p in range(2)])
    prior = {"t:article": PRIOR_ARTICLE, "t:main": PRIOR_ARTICLE, "t:html": -PRIOR_ARTICLE, "t:body": -PRIOR_ARTICLE}
    prior |= {f"c:{w}": PRIOR_OTHER for w in OTHER}
    names = sorted({f for fs in feats for f in fs} | set(prior))
    index = {f: k for k, f in enumerate(names)}
    mean = np.array([prior.get(f, 0.0) for f in names] + [0.0])
    w = mean.copy()
    if feats:
        rows = np.repeat(np.arange(len(feats)), [len(f) + 1 for f in feats])
        cols = np.fromiter((k for fs in feats for k in [*[index[f] for f in fs], len(names)]), np.int64)
        y = np.array(target, float)
        pace = np.zeros(len(w)) + 1e-8
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], len(feats)), -30, 30)))
            grad = np.bincount(cols, (p - y)[rows], len(w)) / len(y) + 1e-3 * (w - mean)
            pace += grad * grad
            w -= 0.3 * grad / np.sqrt(pace)
    return Model(dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]), edges)


def sampled(pages: DataFrame, most: int = SAMPLE_PAGES) -> list[str]:
    """About ``most`` different pages for training (a hash of the page decides; pages without article markup don't count)."""
    named = pages.select("html").where(F.col("html").rlike("(?i)<(?:article|main)[\\s>]"))
    n = named.select(F.count_distinct(F.xxhash64("html"))).first()[0]
    if not n:
        return []
    u = F.pmod(F.xxhash64("html"), F.lit(1_000_003)) / 1_000_003.0
    rows = named.where(u < min(1.0, most / n)).distinct().toLocalIterator()
    return sorted(r["html"] for r in rows)


def main_text(pages: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns + text."""
    source = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("html").alias("h"))

    def run(batches):
        for part, sources in (x for b in batches for x in text_slices(b, len(keep), SLICE_BYTES, SLICE_ROWS)):
            texts = [model.extract(h) for h in sources]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[: len(keep)], pa.array(texts, pa.string())],
                [*part.schema.names[: len(keep)], "text"],
            )

    base = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[: len(keep)])
    found = map_rows(source, run, base + "text string")
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")


def report(pages: DataFrame) -> DataFrame:
    """Main text and its length of every page."""
    found = main_text(pages, fit(sampled(pages)))
    return found.withColumn("n_chars", F.length("text").cast("long"))
