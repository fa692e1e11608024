"""Main text of web pages: boosted trees over the nodes of a page, decoded so that choices above and below agree."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, dom
from .common import scan, texts_of

#: Made-up layouts and pages of the input that the trees are grown on.
LAYOUTS, PAGES, MAX_PAGE_CHARS, SEED = 500, 200, 60_000, 11
PAGES_AT_ONCE = 200

SCHEMA = "page_id: bigint, url: string, text: string, n_chars: bigint, n_nodes: bigint, n_kept: bigint"

#: Names that pages give to the parts of a layout; for each part tags and class words.
PARTS = {
    "menu": (("nav", "div", "ul", "header"), ("nav", "menu", "navbar", "main-menu", "breadcrumbs", "site-nav", "")),
    "header": (("header", "div"), ("header", "site-header", "masthead", "topbar", "page-header", "")),
    "footer": (("footer", "div"), ("footer", "site-footer", "copyright", "legal", "bottom", "")),
    "sidebar": (("aside", "div", "section"), ("sidebar", "side", "widget-area", "related", "popular-posts", "right-rail")),
    "advert": (("div", "aside", "section"), ("ad", "ads", "advert", "banner", "sponsored", "promo-box", "ad-slot")),
    "notice": (("div", "section", "dialog", "aside"), ("cookie-notice", "notice", "alert", "consent", "popup", "gdpr-banner", "privacy-notice")),
    "form": (("form", "div"), ("search", "newsletter", "login-form", "subscribe", "contact-form", "")),
    "comments": (("section", "div", "ul", "ol"), ("comments", "comment-list", "discussion", "replies", "reader-comments", "responses comments")),
    "share": (("div", "ul"), ("share", "social", "sharing-buttons", "social-links")),
}
ARTICLES = (("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("div", "post-content"), ("div", "entry"), ("section", "story"), ("div", "main-text"), ("div", ""))


def layout(rng: random.Random) -> str:
    """A made-up page; ``data-keep`` tells which nodes hold main text."""
    letters = "etaoinshrdluäéñ"

    def words(low: int, high: int, stops: bool = True) -> str:
        out = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
        return " ".join(w + rng.choice((".", ",", "", "", "", "")) * stops for w in out)

    def node(tag: str, name: str, keep: int, inner: str) -> str:
        named = f' {rng.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f'<{tag}{named} data-keep="{keep}">{inner}</{tag}>'

    def links(keep: int) -> str:
        return node("ul", "", keep, "".join(node("li", "", keep, f'<a href="/{words(1, 1, False)}">{words(1, 3, False)}</a>') for _ in range(rng.randint(2, 9))))

    def part(kind: str) -> str:
        tags, names = PARTS[kind]
        tag, name = rng.choice(tags), rng.choice(names)
        if not name and tag == "div":
            name = names[0]
        if tag in ("ul", "ol"):
            return node(tag, name, 0, "".join(node("li", "", 0, rng.choice((f"<a href='/x'>{words(1, 3)}</a>", words(3, 25)))) for _ in range(rng.randint(2, 8))))
        if kind in ("menu", "share"):
            inner = rng.choice((links(0), "".join(f'<a href="/{k}">{words(1, 2, False)}</a> ' for k in range(rng.randint(2, 8)))))
        elif kind == "comments":
            inner = node("h3", "", 0, words(1, 3)) + "".join(node("div", rng.choice(("comment", "reply", "")), 0, rng.choice((node("p", "", 0, words(3, 60)), words(3, 40)))) for _ in range(rng.randint(1, 6)))
        elif kind == "form":
            inner = words(1, 6) + '<input name="q"><button>go</button>' + rng.choice(("", node("p", "", 0, words(3, 15))))
        elif kind == "sidebar":
            inner = rng.choice(("", node("h3", "", 0, words(1, 4)))) + rng.choice((links(0), node("p", "", 0, words(5, 40))))
        else:
            inner = rng.choice((words(3, 30), node("p", "", 0, words(3, 40)), f'{words(2, 8)} <a href="/y">{words(1, 3)}</a>', links(0)))
        return node(tag, name, 0, inner)

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.72:
            return node("p", "", 1, rng.choice(("", "", "<b>")) + words(1, rng.choice((6, 40, 120, 300))) + rng.choice(("", "", "<br>", f' <a href="/z">{words(1, 4)}</a> ')))
        if kind < 0.82:
            return node(rng.choice(("h2", "h3", "h4")), "", 1, words(1, 8, False))
        if kind < 0.9:
            return node(rng.choice(("ul", "ol")), "", 1, "".join(node("li", "", 1, words(2, 25)) for _ in range(rng.randint(2, 6))))
        if kind < 0.94:
            return node("blockquote", "", 1, node("p", "", 1, words(5, 60)))
        if kind < 0.97:
            return node("table", "", 1, "".join(node("tr", "", 1, "".join(node("td", "", 1, words(1, 5)) for _ in range(3))) for _ in range(rng.randint(2, 5))))
        return node(rng.choice(("pre", "figcaption", "div")), "", 1, words(3, 40))

    body = [paragraph() for _ in range(rng.choice((1, 2, 3, 6, 12, 25)))]
    for _ in range(rng.choice((0, 0, 1, 2))):
        body.insert(rng.randint(0, len(body)), part(rng.choice(("advert", "share", "sidebar", "form", "notice"))))
    if rng.random() < 0.15:
        body.append(part("comments"))
    if rng.random() < 0.8:
        body.insert(0, node("h1", "", 1, words(2, 14, False)))
    tag, name = rng.choice(ARTICLES)
    main = node(tag, name, 1, "".join(body))
    for _ in range(rng.choice((0, 0, 1, 2))):
        main = node("div", rng.choice(("wrapper", "container", "", "page", "row", "layout")), 1, rng.choice(("", part("sidebar"), part("menu"))) + main + rng.choice(("", part("sidebar"), part("comments"))))
    before = "".join(part(k) for k in rng.sample(("menu", "header", "notice", "advert", "form"), rng.randint(0, 4)))
    after = "".join(part(k) for k in rng.sample(("footer", "sidebar", "comments", "advert", "share", "menu", "notice"), rng.randint(0, 5)))
    return f'<html><head><title>{words(2, 8)}</title></head><body data-keep="1">{before}{main}{after}</body></html>'


def weak_labels(page: dom.Page) -> np.ndarray | None:
    """Labels of a page that marks its one article: what is in it or above it, but for parts named otherwise; else None."""
    marked = [i for i, t in enumerate(page.tag) if t in ("article", "main")]
    if len(marked) != 1:
        return None
    y = np.zeros(len(page.tag))
    i = marked[0]
    while i >= 0:
        y[i] = 1
        i = page.parent[i]
    for i in range(marked[0] + 1, len(page.tag)):
        named = any(w in k for w in page.words[i] for k in dom.BAD_KINDS) or dom.GROUP_OF[page.tag[i]] in (6, 7, 8, 9, 10)
        p = page.parent[i]
        y[i] = float(y[p] and (p == marked[0] or p > marked[0]) and not named)
    return y


def fit(pages: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> dict:
    """Trees grown on made-up layouts with known labels and on pages that mark their article."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(layouts):
        page = dom.Page(layout(rng))
        y = np.array([float(m or 1) for m in page.marks])
        xs.append(dom.features(page))
        ys.append(y)
    for html in pages:
        page = dom.Page(html)
        if (y := weak_labels(page)) is not None:
            xs.append(dom.features(page))
            ys.append(y)
    return boosting.fit(np.concatenate(xs), np.concatenate(ys))


def texts(model: dict, htmls: list[str | None]):
    """Main text, nodes and kept nodes of each page."""
    pages = [dom.Page(h) for h in htmls]
    if not pages:
        return []
    odds = boosting.log_odds(model, np.concatenate([dom.features(p) for p in pages]))
    out, at = [], 0
    for page in pages:
        n = len(page.tag)
        kept = dom.decoded(page, odds[at : at + n])
        at += n
        out.append(("\n".join(t for node, t in page.runs if kept[node]), n, int(kept.sum())))
    return out


def sampled(pages: DataFrame, n: int) -> list[str]:
    """The ``n`` different pages with the least hashes. The hashes alone are ranked, so that no task sends more than ``n`` numbers."""
    some = pages.where(F.col("html").isNotNull() & (F.length("html") <= MAX_PAGE_CHARS)).select(F.xxhash64("html").alias("o"), "html")
    least = [r["o"] for r in some.select("o").distinct().orderBy("o").limit(n).collect()]
    if not least:
        return []
    rows = some.where(F.col("o") <= least[-1]).groupBy("o").agg(F.min("html").alias("html")).orderBy("o")
    return [r["html"] for r in rows.collect()]


def main_text(pages: DataFrame, model: dict | None = None, sample_pages: int = PAGES) -> DataFrame:
    """Main text of every whole page.

    Reads ``page_id``, ``url`` and ``html``; other columns are ignored. A page becomes a tree of its block elements. Boosted trees
    give each node the odds of holding main text from its tag, the words in its attributes and in those above it, subtree density, link share,
    depth and siblings. The decoding picks the likeliest choice in which nothing is kept below a dropped node. Character
    references are decoded, white space inside a block becomes one space, and kept blocks are joined by line ends.

    The trees are grown on the driver from made-up layouts and from at most ``sample_pages`` pages of the input, of at most
    ``MAX_PAGE_CHARS`` characters, that mark their article. Null and empty pages, and pages without main text, give an empty
    text. Null ids and addresses stay null. Repeated rows give repeated results; an empty table gives none.
    """
    if model is None:
        model = fit(sampled(pages, sample_pages))
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def start():
        m = sent.value

        def work(batch):
            htmls = texts_of(batch, "html")
            for at in range(0, len(htmls), PAGES_AT_ONCE):
                found = texts(m, htmls[at : at + PAGES_AT_ONCE])
                part = batch.slice(at, PAGES_AT_ONCE)
                yield {
                    "page_id": part.column(0), "url": part.column(1), "text": [t for t, _, _ in found], "n_chars": [len(t) for t, _, _ in found],
                    "n_nodes": [n for _, n, _ in found], "n_kept": [k for _, _, k in found],
                }

        return work

    return scan(pages, ["page_id", "url", "html"], SCHEMA, start)
