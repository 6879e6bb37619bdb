"""Main text of web pages by the distribution of text lengths over sliding windows of lines (blocks)."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import quoted

#: Lines of a window.
WINDOW = 3
#: Characters that a window needs for a surge; on pages with little text a share of the fullest window is enough.
SURGE, SURGE_SHARE = 90, 0.25
#: Share of the text found that the innermost element must hold to count as the article.
HOLDS = 0.7

# Elements of HTML by how they are laid out, and names that pages give to what is not their article.
_RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HOLDERS = {
    "html", "body", "div", "section", "article", "main", "ul", "ol", "dl", "table", "blockquote", "figure", "details", "center", "fieldset",
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "noscript", "template", "svg", "button", "select", "object", "canvas", "video", "audio", "head",
}
_BLOCKS = _HOLDERS | {"address", "dd", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "legend", "li", "p", "pre", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "option"}
_ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "noscript", "template", "svg", "button", "select", "object", "canvas", "video", "audio", "head"}
_ASIDE_NAMES = {
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "footer", "contentinfo", "copyright", "sidebar", "complementary",
    "aside", "widget", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice",
    "notices", "notification", "alert", "popup", "modal", "dialog", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
    "recommended", "pagination", "pager", "search", "form", "toolbar", "skip", "disclaimer",
}
_COMMENT_NAMES = {"comment", "comments", "commentlist", "disqus", "discussion", "replies", "reply", "respond"}
_NOT_NAMES = {"has", "with", "no", "without", "not"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>?+""")
_MARK = re.compile(r"<(?=[a-zA-Z!?/])")
_ATTR = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]*+)))?+""")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}


@dataclass
class Line:
    """A block of text: its words, the characters outside of links, and the number of the innermost element that holds it."""

    text: str
    weight: int
    holder: int


@dataclass
class _Open:
    name: str
    number: int
    aside: bool
    reader: bool
    apart: bool  # in an aside or a footer


@dataclass
class _Page:
    """Lines, the elements that hold an article, and for each element the number of the one around it (0: the page)."""

    lines: list[Line] = field(default_factory=list)
    articles: set[int] = field(default_factory=set)
    around: list[int] = field(default_factory=lambda: [0])
    whole: set[int] = field(default_factory=lambda: {0})  # the page, its html and body

    def within(self, found: set[int]) -> list[bool]:
        """For each element whether it is, or is in, one of those found; an element has a larger number than those around it."""
        out = [0 in found]
        for k, up in enumerate(self.around[1:], 1):
            out.append(k in found or out[up])
        return out


def _names(attrs: str) -> tuple[bool, bool]:
    """(is not the article, is readers' comments) by class, id, role and visibility."""
    found = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), html.unescape(next((g for g in m.groups()[1:] if g is not None), "")).lower())
    parts = [p for k in ("class", "id") for name in found.get(k, "").split() if not _NOT_NAMES & {*(p := re.split(r"[^a-z0-9]+", name))}]
    words = {w for p in parts for w in p} | {found.get("role", "")}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    return hidden or bool(words & _ASIDE_NAMES), bool(words & _COMMENT_NAMES)


def stripped(page: str) -> _Page:
    """The lines of a page without markup, comments, scripts, styles and elements whose name or attributes set them apart from its article.

    One pass from left to right: nothing is read twice, however odd the page. A tag, comment, script or style without an end goes on to the end of the page.
    """
    out, opened = _Page(), Counter()
    stack = [_Open("", 0, False, False, False)]
    texts: list[str] = []
    plain, link, at = 0, 0, 0  # link: inside of one

    def end_line() -> None:
        nonlocal plain
        words = " ".join("".join(texts).split())
        if words and not (stack[-1].aside or stack[-1].reader):
            out.lines.append(Line(words, min(plain, len(words)), stack[-1].number))
        texts.clear()
        plain = 0

    def enter(name: str, aside: bool, reader: bool) -> None:
        above = stack[-1]
        out.around.append(above.number)
        stack.append(_Open(name, len(out.around) - 1, aside, reader or above.reader, above.apart or name in ("aside", "footer")))
        opened[name] += 1

    def add(text: str) -> None:
        nonlocal plain
        text = html.unescape(text) if "&" in text else text
        texts.append(text)
        if not link:
            plain += len("".join(text.split()))

    while at < len(page):
        mark = _MARK.search(page, at)
        if mark is None:
            add(page[at:])
            break
        if mark.start() > at:
            add(page[at : mark.start()])
        at = mark.start()
        tag = _TAG.match(page, at)
        if tag is None:  # a comment, a declaration, or an end tag without a name
            stop, size = (page.find("-->", at + 2), 3) if page.startswith("<!--", at) else (page.find(">", at), 1)
            at = len(page) if stop < 0 else stop + size
            continue
        at = tag.end()
        closing, name = bool(tag[1]), tag[2].lower()
        if name == "a":
            link = 0 if closing else 1
        elif name == "br":
            texts.append(" ")
        elif name in _RAW and not closing:
            if name != "title":
                texts.append(" ")
            end = _END[name].search(page, at)
            at = len(page) if end is None else end.start()
        elif name in _BLOCKS:
            end_line()
            link = 0
            if closing:
                while opened[name]:  # what was left open inside ends with it
                    last = stack.pop().name
                    opened[last] -= 1
                    if last == name:
                        break
            elif name in _HOLDERS:
                aside, reader = _names(tag[3]) if name not in ("html", "body") else (False, False)
                main = name in ("article", "main") and not stack[-1].apart
                # the article's own element takes it out of whatever wraps it
                enter(name, not main and (aside or stack[-1].aside or name in _ASIDE), reader)
                if name in ("html", "body"):
                    out.whole.add(stack[-1].number)
                if main and not stack[-1].reader:
                    out.articles.add(stack[-1].number)
            elif name not in _VOID:
                aside, reader = _names(tag[3]) if tag[3] else (False, False)
                if aside or reader:  # a paragraph or item of its own
                    enter(name, True, reader)
    end_line()
    return out


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The text between surges and dives of the window sums, blocks joined by two line feeds; empty if there is none.

    A line's length is that of its text outside of links; on a page that has an article or main element, lines elsewhere count 0. A surge is
    a window of SURGE characters (or SURGE_SHARE of the fullest window), a dive the first window after it that has less than a third of that; lines of
    length 0 at either end are left. If the innermost element that holds most of what was found is not the whole page, text that was found
    elsewhere goes, and neighbouring lines of that element come in, so short first and last paragraphs stay.
    """
    found = stripped(page or "")
    lines = found.lines
    in_article = found.within(found.articles)
    inside = [in_article[x.holder] for x in lines]
    held = any(inside)
    sizes = [x.weight if ok or not held else 0 for x, ok in zip(lines, inside)]
    sums = [0, *accumulate(sizes)]
    n = len(lines)
    windows = [sums[min(i + window, n)] - sums[i] for i in range(n)]
    top = max(windows, default=0)
    if not top:
        # links only: the article's element is all that is left to go by
        return "\n\n".join(x.text for x, ok in zip(lines, inside) if ok)
    surge = max(1.0, min(SURGE, SURGE_SHARE * top))
    kept, i = [False] * n, 0
    while i < n:
        if windows[i] < surge:
            i += 1
            continue
        dive = i
        while dive < n and windows[dive] >= max(1.0, surge / 3):
            dive += 1
        a, b = i, min(dive + window - 1, n)
        while a < b and not sizes[a]:
            a += 1
        while b > a and not sizes[b - 1]:
            b -= 1
        kept[a:b] = [True] * (b - a)
        i = max(dive, i + 1)
    totals = [0] * len(found.around)
    for line, size, k in zip(lines, sizes, kept):
        totals[line.holder] += size * k
    for k in range(len(totals) - 1, 0, -1):
        totals[found.around[k]] += totals[k]
    holder = max(k for k, t in enumerate(totals) if t >= HOLDS * totals[0])
    in_holder = found.within({holder})
    own = [in_holder[x.holder] for x in lines]
    if holder not in found.whole:
        kept = [k and o for k, o in zip(kept, own)]
        if any(kept):
            first, last = kept.index(True), n - 1 - kept[::-1].index(True)
            while first > 0 and own[first - 1]:
                first -= 1
            while last < n - 1 and own[last + 1]:
                last += 1
            kept = [k or (o and first <= at <= last) for at, (k, o) in enumerate(zip(kept, own))]
    return "\n\n".join(x.text for x, k in zip(lines, kept) if k)


@F.pandas_udf(StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id_col, url_col, text (empty if none), n_chars (code points).

    Pages are read whole and apart from each other: no shuffle. A null page is empty; repeated rows, null ids and null urls are rows like others. Other
    columns are left out.
    """
    rows = pages.select(quoted(id_col).alias(id_col), quoted(url_col).alias(url_col), _main_texts(F.coalesce(quoted(html_col), F.lit(""))).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
