"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

Each element has features of its tag, its attributes' tokens, its depth and
siblings, and the text, links and tags of its subtree. Gradient-boosted trees
give the probability that an element holds main text. Decoding then takes the
most likely choice of elements in which whatever lies inside a dropped element
is dropped, too, by a dynamic programme from the leaves up.

The trees are trained here on pages made from a seeded generator, which knows
the label of each element. Training takes some seconds on the driver; the model
is a few kilobytes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import dom
from tidemark.llm.common import frugal, parts

TREES, DEPTH, BINS, RATE = 60, 4, 32, 0.25
TRAINING_PAGES = 400

#: Tokens of class, id, role and the like, by what they hint at. Fixed values.
HINTS = {
    "content": "article articlebody body content copy entry main post prose richtext story text",
    "menu": "breadcrumb breadcrumbs links menu menubar nav navbar navigation pager pagination skip tabs toc toolbar topnav",
    "header": "banner brand header hero logo masthead site tagline top topbar",
    "footer": "bottom colophon copyright foot footer legal",
    "side": "aside complementary popular rail recommended related sidebar trending widget widgets",
    "notice": "alert announcement consent cookie cookies dialog disclaimer gdpr message modal notice notification overlay paywall popup privacy toast warning",
    "advert": "ad ads adslot advert advertisement advertising affiliate promo promoted promotion sponsor sponsored",
    "form": "contact field form input login newsletter register search searchbox signin signup subscribe subscription",
    "comment": "comment commentlist comments discussion disqus feedback replies reply respond response responses",
    "share": "author byline date facebook follow meta share sharing social tags twitter",
}
_HINT_OF = {w: k for k, words in enumerate(HINTS.values()) for w in words.split()}
TAGS = [
    "p", "h1", "h2", "h3", "li", "ul", "ol", "a", "div", "span", "section", "article", "main", "body", "nav", "header", "footer", "aside", "form", "button", "label",
    "td", "table", "blockquote", "pre", "figure", "figcaption", "html", "head", "select", "dialog",
]
_TAG_OF = {t: i + 1 for i, t in enumerate(TAGS)}
_MENU_TAGS = np.array([t in ("nav", "header", "footer", "aside", "form", "button", "select", "dialog") for t in ["", *TAGS]])
_A, _P, _H1, _ARTICLE, _MAIN = (_TAG_OF[t] for t in ("a", "p", "h1", "article", "main"))


def features(nodes: dom.Nodes) -> np.ndarray:
    """Features of every node of a page: nodes x features."""
    n = len(nodes.tag)
    tag = np.fromiter((_TAG_OF.get(t, 0) for t in nodes.tag), dtype=np.int64, count=n)
    parent, depth, end = np.array(nodes.parent), np.array(nodes.depth), np.array(nodes.end)
    hints = np.zeros((n, len(HINTS)), dtype=bool)
    for i, tokens in enumerate(nodes.tokens):
        for w in tokens:
            k = _HINT_OF.get(w)
            if k is not None:
                hints[i, k] = True
    chars, words, stops, pieces = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for node, text in nodes.segments:
        if text:
            m = len(text)
            chars[node] += m
            words[node] += text.count(" ") + 1
            stops[node] += text.count(".") + text.count(",")
            pieces[node] += 1
    up = np.maximum(parent, 0)

    def below(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[end] - total[:n]

    in_link = tag == _A
    boiler = hints[:, 1:].any(axis=1) | _MENU_TAGS[tag] | np.array(nodes.hidden)
    over_boiler, over_content, over_link = np.zeros(n), np.zeros(n), np.zeros(n)
    content = hints[:, 0] | (tag == _ARTICLE) | (tag == _MAIN)
    first = np.zeros(n)  # place among siblings
    seen = np.zeros(n)
    up_list, boiler_list, content_list, link_list = parent.tolist(), boiler.tolist(), content.tolist(), in_link.tolist()
    ob, oc, ol, fi, se = over_boiler.tolist(), over_content.tolist(), over_link.tolist(), first.tolist(), seen.tolist()
    for i in range(1, n):
        p = up_list[i]
        ob[i] = ob[p] + boiler_list[p]
        oc[i] = oc[p] + content_list[p]
        ol[i] = ol[p] or link_list[p]
        fi[i] = se[p]
        se[p] += 1
    over_boiler, over_content, over_link, first, siblings = (np.array(x, dtype=float) for x in (ob, oc, ol, fi, se))
    all_chars, all_words, all_stops = below(chars), below(words), below(stops)
    link_chars = below(chars * ((over_link > 0) | in_link))
    paragraphs, headings = below(tag == _P), below(tag == _H1)
    total = max(all_chars[0], 1)
    columns = [
        *(tag == k + 1 for k in range(len(TAGS))), *hints.T, *hints[up].T,
        depth, np.log1p(siblings[up]), first / np.maximum(siblings[up], 1), np.log1p(siblings),
        np.log1p(all_chars), np.log1p(chars), all_chars / total, np.log1p(all_chars / (end - np.arange(n))),
        link_chars / np.maximum(all_chars, 1), np.log1p(all_words), all_stops / np.maximum(all_words, 1), all_words / np.maximum(below(pieces), 1),
        paragraphs, headings, below(boiler) / (end - np.arange(n)), over_boiler, over_content, over_link, np.array(nodes.hidden), boiler, content,
        tag[up] == _ARTICLE, tag[up] == _MAIN, _MENU_TAGS[tag[up]], below(content) > 0,
    ]
    return np.stack([np.asarray(c, dtype=np.float32) for c in columns], axis=1)


# Boosted trees

@dataclass
class Trees:
    """Complete binary trees of one depth: split features and thresholds level by level, and leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Fit logistic loss by second-order boosting over feature histograms."""
    inner, n_features = 2**DEPTH - 1, x.shape[1]
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(n_features)]
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p) + 1e-9
        at = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            low, width = 2**level - 1, 2**level
            gain, choice = np.zeros(width), [(0, np.inf, BINS)] * width
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (at - low) * BINS + bins[:, k]
                gs, hs = (np.bincount(key, weights=w, minlength=width * BINS).reshape(width, BINS) for w in (g, h))
                gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                better = (gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1))[:, : len(c)]
                better[(hl < 1)[:, : len(c)] | (ht - hl < 1)[:, : len(c)]] = 0
                best = better.argmax(axis=1)
                for node in range(width):
                    if better[node, best[node]] > gain[node] + 1e-9:
                        gain[node], choice[node] = better[node, best[node]], (k, c[best[node]], best[node])
            for node, (k, t, _) in enumerate(choice):
                feature[low + node], threshold[low + node] = k, t
            which = np.array([k for k, _, _ in choice])
            limit = np.array([b for _, _, b in choice])
            at = 2 * at + 1 + (bins[np.arange(len(y)), which[at - low]] > limit[at - low])
        leaf = at - inner
        value = -RATE * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + 1)
        margin += value[leaf]
        features.append(feature), thresholds.append(threshold.astype(np.float32)), values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


# Training pages

class _Maker:
    """A seeded maker of pages; main text is marked, so that each element's label is known."""

    MARK = ""  # begins every run of main text

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def pick(self, *of):
        return of[int(self.rng.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        out = ["".join(self.pick("an", "de", "er", "la", "in", "tho", "st", "re", "qu", "ou", "ing", "ü", "é") for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n)]
        for i in range(n):
            if self.chance(0.12):
                out[i] += self.pick(".", ",", ".", "!!", "***", " |")
        if self.chance(0.08):
            out = [w.upper() for w in out]
        return " ".join(out).capitalize()

    def attr(self, *names: str) -> str:
        if not names:
            return ""
        name = self.pick(*names)
        extra = self.pick("", "", " box", " clearfix", " wide", " col-3", " js-x")
        return f' {self.pick("class", "class", "id")}="{self.pick("", "", "c-", "x-", "page-")}{name}{extra}"'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(int(self.rng.integers(low, high + 1)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.6) else " ".join(items)

    def boiler(self, kind: str) -> str:
        w, a = self.words, self.attr
        paragraph = f"<p>{w(4, 60)}</p>" if self.chance(0.5) else w(4, 60)
        if kind == "nav":
            tag, attr = self.pick(("nav", ""), ("div", a("menu", "nav", "navbar", "breadcrumbs")), ("nav", a("menu", "main-nav")))
            return f"<{tag}{attr}>{self.links(3, 12)}</{tag}>"
        if kind == "header":
            tag, attr = self.pick(("header", ""), ("div", a("header", "masthead", "topbar")), ("header", a("site-header")))
            title = f"<h1>{w(1, 5)}</h1>" if self.chance(0.5) else f'<a href="/">{w(1, 4)}</a>'
            return f"<{tag}{attr}>{title}{paragraph if self.chance(0.5) else ''}{self.links(2, 6) if self.chance(0.4) else ''}</{tag}>"
        if kind == "footer":
            tag, attr = self.pick(("footer", ""), ("div", a("footer", "bottom", "copyright")), ("footer", a("site-footer")))
            return f"<{tag}{attr}>&copy; {paragraph}{self.links(2, 8) if self.chance(0.5) else ''}</{tag}>"
        if kind == "side":
            tag, attr = self.pick(("aside", ""), ("aside", a("sidebar", "related")), ("div", a("sidebar", "related", "widget", "trending")), ("section", a("related-posts", "sidebar")))
            return f"<{tag}{attr}><{self.pick('h2', 'h3', 'h4')}>{w(1, 4)}</h3>{self.links(2, 8) if self.chance(0.6) else paragraph}</{tag}>"
        if kind == "notice":
            attr = self.pick(a("cookie-notice", "notice", "alert", "consent", "popup", "modal"), ' role="alert"', ' role="dialog"', ' hidden')
            return f"<{self.pick('div', 'section', 'div')}{attr}>{paragraph}{'<button>' + w(1, 2) + '</button>' if self.chance(0.6) else ''}</div>"
        if kind == "ad":
            attr = a("ad", "ads", "advert", "advertisement", "promo", "sponsored", "ad-banner")
            body = self.pick(w(3, 40), f"<p>{w(3, 40)}</p>", f'<a href="/x">{w(2, 12)}</a>')
            return self.pick(f"<div{attr}>{body}</div>", f"<aside{attr}>{body}</aside>", f"<section{attr}>{body}</section>", f"<p{attr}>{w(3, 30)}</p>")
        if kind == "form":
            fields = "".join(f"<label>{w(1, 3)}</label><input name=a><select><option>{w(1, 2)}<option>{w(1, 2)}</select>" for _ in range(int(self.rng.integers(1, 4))))
            return f"<form{self.pick('', a('search', 'newsletter', 'login', 'contact-form'))}>{paragraph if self.chance(0.5) else ''}{fields}<button>{w(1, 2)}</button></form>"
        if kind == "comments":
            one = lambda: f"<{self.pick('div', 'li', 'article')}{a('comment', 'comment-body', 'reply')}><span>{w(1, 2)}</span><p>{w(5, 80)}</p></div>"
            tag, attr = self.pick(("section", a("comments", "discussion", "responses")), ("div", a("comments", "commentlist", "disqus")))
            return f"<{tag}{attr}><h3>{w(1, 3)}</h3>{''.join(one() for _ in range(int(self.rng.integers(1, 6))))}</{tag}>"
        return f"<{self.pick('div', 'p', 'ul')}{a('share', 'social', 'byline', 'tags', 'meta')}>{self.links(1, 4)}</div>"

    def article(self) -> str:
        k, w = self.MARK, self.words
        out = [f"<h1>{k}{w(2, 12)}</h1>"] if self.chance(0.8) else []
        for _ in range(int(self.rng.integers(1, 14))):
            r = self.rng.random()
            if r < 0.6:
                text = k + w(1, 120)
                if self.chance(0.25):
                    text += f' <a href="/y">{k}{w(1, 4)}</a> {k}{w(1, 20)}'
                if self.chance(0.15):
                    text += f" <span>{k}{w(1, 6)}</span> {k}{w(1, 9)}"
                out.append(self.pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<div>{text}</div>"))
            elif r < 0.7:
                out.append(f"<{self.pick('h2', 'h3')}>{k}{w(1, 8)}</h2>")
            elif r < 0.78:
                out.append("<ul>" + "".join(f"<li>{k}{w(2, 20)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>")
            elif r < 0.83:
                out.append(f"<blockquote><p>{k}{w(5, 50)}</p></blockquote>")
            elif r < 0.87:
                out.append("<table>" + "".join(f"<tr><td>{k}{w(1, 4)}</td><td>{k}{w(1, 4)}</td></tr>" for _ in range(int(self.rng.integers(2, 5)))) + "</table>")
            elif r < 0.9:
                out.append(f"<figure><img src=a><figcaption>{k}{w(2, 15)}</figcaption></figure>")
            elif r < 0.92:
                out.append(f"<pre><code>{k}{w(3, 30)}</code></pre>")
            else:
                out.append(self.boiler(self.pick("ad", "ad", "share", "side", "notice", "form")))
        return "".join(out)

    def page(self) -> str:
        tag, attr = self.pick(("article", ""), ("article", ""), ("main", ""), ("article", self.attr("post", "story", "entry")), ("div", self.attr("article", "content", "post", "entry-content", "story-body", "main")), ("section", self.attr("article", "content", "text")))
        body = f"<{tag}{attr}>{self.article()}</{tag}>"
        if self.chance(0.25):
            body = f"<main>{body}{self.boiler('comments') if self.chance(0.4) else ''}</main>"
        if self.chance(0.35):
            body = f"<div{self.attr('wrapper', 'container', 'page', 'content')}>{body}{self.boiler(self.pick('side', 'comments', 'ad'))}</div>"
        above = [self.boiler(x) for x in ("header", "nav", "notice", "ad", "form") if self.chance(0.5)]
        under = [self.boiler(x) for x in ("comments", "side", "share", "ad", "form", "footer", "notice") if self.chance(0.45)]
        end = "</body></html>" if self.chance(0.8) else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>{''.join(above)}<!-- x -->{body}{''.join(under)}{end}"


def _labels(nodes: dom.Nodes) -> np.ndarray:
    own = np.zeros(len(nodes.tag))
    for node, text in nodes.segments:
        if text and _Maker.MARK in text:
            own[node] = 1
    total = np.concatenate([[0], np.cumsum(own)])
    return (total[np.array(nodes.end)] > total[: len(own)]).astype(float)


def training_set(pages: int = TRAINING_PAGES, seed: int = 6):
    """Features and labels of the elements of generated pages."""
    maker = _Maker(np.random.default_rng(seed))
    xs, ys = [], []
    for _ in range(pages):
        nodes = dom.parse(maker.page())
        labels = _labels(nodes)
        nodes.segments = [(i, t and t.replace(_Maker.MARK, "")) for i, t in nodes.segments]
        xs.append(features(nodes)), ys.append(labels)
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(maxsize=1)
def model() -> Trees:
    return boost(*training_set())


# Decoding

def decode(margin: np.ndarray, parent: list[int], end: np.ndarray) -> list[bool]:
    """The most likely set of kept nodes in which a kept node's ancestors are kept; the page itself always is."""
    keep_log, drop_log = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    total = np.concatenate([[0], np.cumsum(drop_log)])
    dropped = (total[end] - total[: len(margin)]).tolist()
    kept = keep_log.tolist()
    for i in range(len(kept) - 1, 0, -1):
        kept[parent[i]] += kept[i] if kept[i] > dropped[i] else dropped[i]
    out = [True] * len(kept)
    for i in range(1, len(kept)):
        out[i] = out[parent[i]] and kept[i] > dropped[i]
    return out


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page; a null or empty page has none."""
    parsed = [dom.parse(p or "") for p in pages]
    found = [features(n) for n in parsed]
    margins = np.split(trees.margin(np.concatenate(found)), np.cumsum([len(f) for f in found])[:-1]) if found else []
    out = []
    for nodes, margin in zip(parsed, margins):
        kept = decode(margin, nodes.parent, np.array(nodes.end))
        out.append(dom.blocks(s for s in nodes.segments if s[1] is dom.BREAK or kept[s[0]]))
    return out


def main_text(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``.

    ``pages`` has page_id, url and html; other columns are ignored. Text is the
    kept elements' blocks in page order, joined by line ends; it is empty for a
    null or empty html and where no element is kept. Text outside any element
    is an implied body's. Repeated rows and null ids stay. Nothing is dropped or capped.
    """
    trees = trees or model()

    def run(batches):
        for some in parts(batches, 2):
            texts = extract(some.column(2).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(frugal(run), "page_id long, url string, text string, n_chars long")
