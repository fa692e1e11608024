"""Block trees of web pages and the features of their nodes."""

from __future__ import annotations

import re
from html import unescape

import numpy as np

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<odd>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Raw text up to the closing tag, or to the end of the page as browsers read it.
RAW = {"script", "style", "noscript", "textarea", "title", "iframe"}
#: Elements without text of their own, left out up to their closing tag; those without one up to the next block boundary.
DROPPED = {"template", "svg", "select", "datalist", "button", "optgroup", "option", "object", "canvas", "annotation", "annotation-xml"}
ANY_DROPPED = re.compile(rf"<(?:{'|'.join(DROPPED)})[\s/>]", re.I)
#: Blocks whose closing tag can be left out.
OPTIONAL = {"p", "li", "dt", "dd", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
GROUPS = (
    {"p"}, HEADINGS, {"li", "dt", "dd"}, {"ul", "ol", "dl", "menu"}, {"article", "main"}, {"section", "div", "center"}, {"nav"}, {"header"},
    {"footer", "address"}, {"aside"}, {"form", "fieldset", "dialog"}, {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"},
    {"blockquote", "pre", "figure", "figcaption"}, {"html", "body"}, {"head", "details", "summary"},
)
BLOCKS = set().union(*GROUPS)
GROUP_OF = {t: k for k, g in enumerate(GROUPS) for t in g}
#: An opening tag ends open tags of these kinds, up to the nearest tag of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Words in class, id and role that speak for or against content.
GOOD = {"article", "content", "post", "entry", "story", "body", "main", "text", "page", "blog", "prose"}
BAD_KINDS = (
    {"nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs"},
    {"ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "adsense", "adbox"},
    {"footer", "header", "masthead", "copyright", "legal", "logo", "topbar", "bottom", "contentinfo"},
    {"sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "rail", "complementary", "more"},
    {"comment", "comments", "reply", "replies", "discussion", "respond", "disqus", "commentlist", "reader"},
    {"cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "warning", "gdpr", "privacy", "toast", "message"},
    {"share", "sharing", "social", "subscribe", "newsletter", "login", "signup", "search", "form", "signin", "register", "contact"},
)


#: Words before a part of a name that only say what a block comes with, not what it is: with-sidebar, has-related, learn-more.
QUALIFIERS = {"with", "without", "has", "no", "not", "is", "can", "learn", "read", "show", "hide"}
#: Words against content that say little beside a word for it in the same name: message-body, article-header.
WEAK = {"message", "more", "side", "reader", "header", "alert", "warning", "bottom"}
HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)


def name_words(value: str) -> list[str]:
    """Words of the names in a class, id or role: a qualified name says nothing, a weak word yields to a word for content."""
    out = []
    for name in value.split():
        parts = [w.lower() for w in PART.findall(name)]
        if len(parts) > 1 and parts[0] in QUALIFIERS:
            continue
        good = any(w in GOOD for w in parts)
        out += [w for w in parts if not (good and w in WEAK)]
    return out


def last_tag(html: str) -> int:
    """Where the last tag can end: what follows is text, however many tags it seems to open."""
    return html.rfind(">") + 1


def raw_end(html: str, name: str, at: int) -> int:
    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
    return end.end() if end else len(html)


def closed(html: str) -> dict[int, int]:
    """The end of each dropped element that has its closing tag before its parent block ends, by the end of its opening tag."""
    out, stack, at = {}, [], 0  # open blocks and dropped elements with the end of their tags
    if not ANY_DROPPED.search(html):
        return out
    held, limit = dict.fromkeys(BLOCKS | DROPPED, 0), last_tag(html)
    while m := TOKEN.search(html, at, limit):
        at = m.end()
        name = (m["open"] or m["odd"] or "").lower()
        if name in RAW and not m[0].endswith("/>"):
            at = raw_end(html, name, at)
        elif name in held and not m[0].endswith("/>"):
            stack.append((name, at))
            held[name] += 1
        elif held.get(name := (m["close"] or "").lower()):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in DROPPED:
                        out[stack[k][1]] = at
                    for other, _ in stack[k:]:
                        held[other] -= 1
                    del stack[k:]
                    break
                if name in DROPPED and stack[k][0] not in DROPPED | OPTIONAL:
                    break
    return out


class Page:
    """Nodes in page order (a parent before its children) and the runs of text between block boundaries."""

    def __init__(self, html: str | None):
        self.parent, self.tag, self.words, self.marks, self.inline, self.fields = [-1], ["html"], [[]], [""], [0], [0]
        self.runs: list[tuple[int, str]] = []  # (node, text), not empty
        self.linked: list[int] = [0]
        self._parse(html or "")

    def _parse(self, html: str) -> None:
        stack, pieces, in_link, at = [0], [], False, 0
        ends, muted = closed(html), False

        def flush():
            if pieces:
                text = " ".join(unescape("".join(pieces)).split())
                pieces.clear()
                if text:
                    self.runs.append((stack[-1], text))

        find, limit = TOKEN.search, last_tag(html)
        while m := find(html, at, limit):
            if m.start() > at and not muted:
                piece = html[at : m.start()]
                pieces.append(piece)
                if in_link:
                    self.linked[stack[-1]] += len(piece.strip())
            at = m.end()
            name = (m["open"] or m["odd"] or "").lower()
            if name:
                if name in RAW:
                    if not m[0].endswith("/>"):
                        at = raw_end(html, name, at)
                    self.fields[stack[-1]] += name == "textarea"
                elif name in DROPPED:
                    if at in ends:
                        at = ends[at]
                    elif not m[0].endswith("/>"):
                        muted = True
                    self.fields[stack[-1]] += name in ("select", "button")
                elif name in BLOCKS:
                    flush()
                    in_link = muted = False
                    tags = self.tag
                    if tags[stack[-1]] == "p":  # holds no blocks
                        stack.pop()
                    if name in ENDS:
                        ended, until = ENDS[name]
                        for k in range(len(stack) - 1, 0, -1):
                            if tags[stack[k]] in until:
                                break
                            if tags[stack[k]] in ended:
                                del stack[k:]
                                break
                    if name == "html" or name == "body" and "body" in tags:
                        continue
                    words, mark = [], ""
                    for k, *v in ATTRIBUTE.findall(m["attrs"] or m["rest"] or ""):
                        k = k.lower()
                        if k in ("class", "id", "role"):
                            words += name_words("".join(v))
                        elif k == "data-keep":
                            mark = "".join(v)
                        elif k == "hidden" or k == "style" and HIDDEN.search("".join(v)):
                            words.append("modal")
                    self.parent.append(stack[-1])
                    tags.append(name)
                    self.words.append(words)
                    self.marks.append(mark)
                    for x in (self.inline, self.fields, self.linked):
                        x.append(0)
                    if not m[0].endswith("/>"):
                        stack.append(len(tags) - 1)
                else:
                    self.inline[stack[-1]] += 1
                    if name == "a":
                        in_link = True
                    elif name == "br" or name == "hr":
                        pieces.append(" ")
                        if name == "hr":
                            flush()
                    elif name == "input":
                        self.fields[stack[-1]] += 1
            elif name := (m["close"] or "").lower():
                if name == "a":
                    in_link = False
                elif name in BLOCKS:
                    flush()
                    muted = False
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == name:
                            del stack[k:]
                            in_link = False
                            break
        if not muted:
            pieces.append(html[at:].partition("<!--")[0])
        flush()


def features(page: Page) -> np.ndarray:
    """A row for each node: tag, attribute words of it and of those above it, subtree density, links, depth, siblings, place."""
    n = len(page.tag)
    own, first, marks = [0] * n, [0] * n, [0] * n
    at = 0
    for node, text in page.runs:
        own[node] += len(text)
        marks[node] += text.count(".") + text.count(",")
    text, links, inner, inline, fields, kids = own[:], page.linked[:], [1] * n, page.inline[:], page.fields[:], [0] * n
    kid_text = [0] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        for x in (text, links, inner, inline, fields, marks):
            x[p] += x[i]
        kids[p] += 1
        kid_text[p] += text[i]
    whole = max(1, text[0])
    rows = []
    depth, rank, above, same, group = [0] * n, [0] * n, [(0,) * 9] * n, {}, [GROUP_OF.get(t, 5) for t in page.tag]
    met = [0] * n
    for i in range(1, n):
        same[page.parent[i], group[i]] = same.get((page.parent[i], group[i]), 0) + 1
    last_start = 0
    for i in range(n):
        p = page.parent[i]
        words = page.words[i]
        good = sum(w in GOOD for w in words)
        bad = [sum(w in k for w in words) for k in BAD_KINDS]
        if i:
            depth[i], rank[i] = depth[p] + 1, met[p]
            met[p] += 1
            over = above[p]
        else:
            over = (0,) * 9
        g = group[i]
        above[i] = (over[0] + good + (g == 4), over[1] + (g in (6, 7, 8, 9, 10)), *(min(1, a + b) for a, b in zip(over[2:], bad)))
        siblings = kids[p] if i else 1
        mean = (kid_text[p] / siblings) if i else text[0]
        one_hot = [0.0] * len(GROUPS)
        one_hot[g] = 1.0
        first[i] = last_start
        last_start += own[i]
        rows.append(
            one_hot
            + [good, *bad, sum(bad), *over]
            + [
                np.log1p(text[i]), np.log1p(own[i]), links[i] / (text[i] + 1), text[i] / (inner[i] + inline[i]), np.log(inner[i]), fields[i],
                marks[i] / (text[i] + 1), depth[i], rank[i], siblings, same.get((p, g), 1) / siblings, np.log1p(mean), text[i] / whole, first[i] / whole,
            ]
        )
    return np.array(rows, float)


def decoded(page: Page, log_odds: np.ndarray) -> np.ndarray:
    """The likeliest keeping of nodes in which nothing is kept below a dropped node.

    From the leaves up: a node is dropped with all that is below it, or kept with the best choice for each child. The root stays.
    """
    n = len(page.tag)
    keep = -np.logaddexp(0, -log_odds)
    drop = -np.logaddexp(0, log_odds)
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and keep[i] > drop[i]
    return kept
