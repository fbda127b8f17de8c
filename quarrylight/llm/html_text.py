"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. A line's length is its characters without link texts; a line
that is all link counts 1 in an element of running text (a paragraph, a heading) and 0 elsewhere, as in a list or a ``div``.
Lines of menus, headers, footers, sidebars, notices, adverts, forms and comment sections (by element, role, class or id)
have length 0 and are never kept. Lengths are summed over a sliding window of ``WINDOW`` lines. Text starts at a surge
point, where a window's sum rises over the threshold, with the short lines that lead up to it (headings, a dateline), and
ends at the dive point, where a window's sum falls to zero: the lines between are kept, a line of links among them too, while
a run of ``WINDOW`` such lines is a menu. On a page that marks its article (``article`` or ``main``) the lines outside have
length 0, any sum over 0 is a surge, and text goes from the first surge to the last dive: links between two paragraphs are
sources, those before or behind all text a menu. Else the threshold is ``SURGE`` characters, or less on a page that has no
such block. Elements whose end tag is left out end where HTML ends them: ``head`` at the first thing that can't be in it, a
menu or form that is never closed at the article. An article in a box that is named like boilerplate (a reader's comment, a
teaser) is text only on a page that has no other.

Every step is linear in the page, however deep its elements are nested or however many are left open.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
#: A container that is named like a layout box is no boilerplate if it holds over half of the text and this many characters.
ROOMY = 600

# HTML's element names by what they do here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Skipped up to their end tag; if there is none, CODE up to the next block, the others not at all.
SKIPPED = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "svg", "select", "audio", "video", "canvas"}
CODE = {"script", "style", "textarea", "title"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dd", "figcaption", "caption", "summary"}
HEAD_CONTENT = {"head", "base", "basefont", "bgsound", "link", "meta", "noscript", "script", "style", "template", "title"}
SIBLINGS = {"li", "td", "th", "tr", "dt", "dd"}
BOILER_ELEMENTS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "head", "button", "search"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar", "tablist"}
# Words in classes and ids that name what is not the article.
BOILER_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies",
    "copyright", "disclaimer", "disqus", "dropdown", "footer", "gdpr", "header", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "navigate", "newsletter", "notice", "notices",
    "notification", "overlay", "pager", "pagination", "popup", "popover", "promo", "promoted", "promotion", "recommended", "related", "reply", "replies", "respond", "share", "sharing", "sidebar", "sidebars",
    "signup", "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "tags", "toolbar", "topbar", "widget", "widgets",
}
# Those of the names above that tell an advert, a teaser or readers' comments by themselves, whatever words stand beside them, and in an article's own class too.
STRONG_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "comment", "comments", "commentlist", "disqus", "newsletter", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "sponsored", "sponsors",
}
# Elements whose text is shown as written, so that classes in them name its tokens.
VERBATIM = ("pre", "code")
# First words of classes that describe a layout ("has-sidebar"), not a part of the page.
LAYOUT_NAMES = {"has", "with", "no", "without", "is"}
# Words that say nothing beside those above ("related-posts", "ad-slot"). In the article a class or id is boilerplate only if all its words are in these two lists.
FILLER_NAMES = {"area", "bar", "block", "box", "buttons", "container", "content", "form", "inner", "item", "items", "left", "links", "list", "outer", "posts", "right", "section", "slot", "unit", "wrap", "wrapper"}
#: Of the names above, those that a page's own title block may have, and those that layouts give to boxes of anything.
TITLE_NAMES = {"header"}
BOX_NAMES = {"header", "widget", "widgets", "modal", "overlay", "banner", "share", "subscribe", "subscription"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_OPEN_END = re.compile(r"<(?:/?[a-zA-Z]|[!?])[^>]*\Z", re.S)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BLOCK_START = re.compile(rf"<(?=/?(?:{'|'.join(sorted(BLOCKS - CODE, key=len, reverse=True))})[\s/>])", re.I)

CLEAR, BOX, NEVER = 0, 1, 2


class Line(NamedTuple):
    """A line of a page: its ``text``, its ``length`` by the measure above, whether it is ``off`` (not main text), ``inside`` the marked article, in an element of ``running`` text."""

    text: str
    length: int
    off: bool
    inside: bool
    running: bool


def _kind(tag: str, attrs: str, in_article: bool, verbatim: bool) -> int:
    """What an element's own tag says: CLEAR, NEVER main text, or BOX, named like boilerplate by a word that layouts also use. In a ``verbatim`` element names say nothing."""
    if tag in BOILER_ELEMENTS or tag == "header" and not in_article:
        return NEVER
    if not attrs.strip():
        return CLEAR
    found = CLEAR
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in ("html", "body", "main") and not verbatim:
            for one in value.split():
                words = [w.lower() for w in _NAME_WORD.findall(one)]
                bad = {w for w in words if w in BOILER_NAMES}
                if not bad or words[0] in LAYOUT_NAMES:
                    continue
                if bad & STRONG_NAMES and words[-1] not in LAYOUT_NAMES:
                    found = NEVER
                    continue
                if tag == "article" or in_article and (bad <= TITLE_NAMES or any(w not in BOILER_NAMES and w not in FILLER_NAMES for w in words)):
                    continue
                found = max(found, BOX if bad <= BOX_NAMES else NEVER)
        elif name == "role" and value.lower() in BOILER_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return NEVER
    return found


class _Scan:
    """The open elements while a page is read, and the lines so far; each open element knows what holds below it."""

    def __init__(self, page: str):
        self.page = page
        self.tags: dict[str, tuple[list[int], list[int]]] = {}  # where the starts and ends of a name are
        self.stack: list[tuple[str, bool, bool, int, bool]] = []  # element, never main text, in the article, innermost box, in an article inside boilerplate
        self.open: defaultdict[str, list[int]] = defaultdict(list)  # each name's places in the stack
        self.blocks: list[int] = []  # places of blocks
        self.boiler = 0
        self.boxes: list[int] = []  # each box's outer one, -1 for none
        self.rows: list[tuple[str, int, bool, bool, int, bool, bool]] = []
        self.parts: list[str] = []
        self.linked = 0

    def state(self) -> tuple[bool, bool, int, bool]:
        return self.stack[-1][1:] if self.stack else (False, False, -1, False)

    def left_open(self, tag: str, at: int) -> bool:
        """Whether no end tag behind ``at`` is left for an open element of that name."""
        if tag not in self.tags:
            self.tags[tag] = tuple([m.start() for m in re.finditer(rf"<{mark}{tag}[\s/>]", self.page, re.I)] for mark in ("", "/"))
        starts, ends = self.tags[tag]
        return len(ends) - bisect.bisect_left(ends, at) <= len(starts) - bisect.bisect_left(starts, at)

    def push(self, tag: str, attrs: str, at: int) -> None:
        here = tag in ("article", "main")
        if here and (self.boiler or self.open["form"]):
            while forgotten := [k for name in (BOILER_ELEMENTS if self.boiler else {"form"}) for k in self.open[name][-1:] if self.left_open(name, at)]:
                for _ in range(len(self.stack) - max(forgotten)):
                    self.pop()
        never, inside, box, doubt = self.state()
        if here and not self.boiler:
            doubt = doubt or never and tag == "article"  # a comment or a teaser, or a wrapper with a telling class that holds the article itself
            never, box = False, -1
        kind = _kind(tag, attrs, inside or here, any(self.open[x] for x in VERBATIM))
        if kind == NEVER and here:
            kind, doubt = CLEAR, True
        if kind == BOX:
            self.boxes.append(box)
            box = len(self.boxes) - 1
        self.open[tag].append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, never or kind == NEVER, inside or here, box, doubt))
        self.boiler += tag in BOILER_ELEMENTS and tag != "form"

    def pop(self) -> None:
        tag = self.stack.pop()[0]
        self.open[tag].pop()
        if tag in BLOCKS:
            self.blocks.pop()
        self.boiler -= tag in BOILER_ELEMENTS and tag != "form"

    def close(self, tag: str) -> None:
        """Closes the innermost open element of that name and all in it; an inline one only within its block."""
        if self.open[tag] and (tag in BLOCKS or not self.blocks or self.open[tag][-1] > self.blocks[-1]):
            for _ in range(len(self.stack) - self.open[tag][-1]):
                self.pop()

    def start_block(self, tag: str) -> None:
        """An inline element that was left open ends with its block, as do a paragraph and a list's or table's item; a head ends at what it can't hold."""
        if self.open["head"] and tag not in HEAD_CONTENT:
            self.close("head")
        while self.stack and self.stack[-1][0] not in BLOCKS:
            self.pop()
        if self.stack and (self.stack[-1][0] == "p" or tag in SIBLINGS and self.stack[-1][0] == tag):
            self.pop()

    def say(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            if self.open["head"] and not text.isspace():
                self.end_line()
                self.close("head")
            self.parts.append(text)
            if self.open["a"]:
                self.linked += len(text.strip())

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            running = bool(self.blocks) and self.stack[self.blocks[-1]][0] in RUNNING
            self.rows.append((text, max(len(text) - self.linked, int(running), 0), *self.state(), running))
        self.parts.clear()
        self.linked = 0

    def lines(self) -> list[Line]:
        """The lines, with every box judged by its share of the text (of the article, if one is marked)."""
        if any(inside and length and not never and not doubt for _, length, never, inside, _, doubt, _ in self.rows):
            self.rows = [(text, length, never or doubt, inside, box, doubt, running) for text, length, never, inside, box, doubt, running in self.rows]
        marked = any(inside for _, _, _, inside, _, _, _ in self.rows)
        held, total = [0] * len(self.boxes), 0
        for _, length, never, inside, box, _, _ in self.rows:
            if not never and (inside or not marked):
                total += length
                if box >= 0:
                    held[box] += length
        for box in range(len(held) - 1, -1, -1):  # an inner box comes after its outer one
            if self.boxes[box] >= 0:
                held[self.boxes[box]] += held[box]
        off: list[bool] = []
        for box, n in enumerate(held):
            off.append(2 * n <= total or n < ROOMY or self.boxes[box] >= 0 and off[self.boxes[box]])
        return [Line(text, 0 if bad else length, bad, inside, running) for text, length, never, inside, box, _, running in self.rows for bad in (never or box >= 0 and off[box],)]


def lines(page: str) -> list[Line]:
    """The non-empty lines of a page in order."""
    page = _OPEN_END.sub("", page) if page.rfind("<") > page.rfind(">") else page
    scan, at, endless = _Scan(page), 0, set()
    while m := _TOKEN.search(page, at):
        scan.say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                scan.say(m[0][9:-3])
            continue
        tag, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or ""
        if closing:
            if tag in BLOCKS:
                scan.end_line()
            scan.close(tag)
        elif tag == "br":
            scan.parts.append(" ")
        elif tag in SKIPPED and not attrs.rstrip().endswith("/"):
            end = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(tag)
                if tag in CODE:
                    block = _BLOCK_START.search(page, at)
                    at = block.start() if block else len(page)
            if tag == "title":
                scan.end_line()
        else:
            if tag in BLOCKS:
                scan.end_line()
                scan.start_block(tag)
            if tag not in VOID:
                scan.push(tag, attrs, at)
    scan.say(page[at:])
    scan.end_line()
    return scan.lines()


def spans(lengths: list[int], threshold: int, window: int = WINDOW, running: list[bool] | None = None) -> list[tuple[int, int]]:
    """Line ranges from a surge point to the dive point after it, first and last line of a length over 0.

    A window's sum is that of the ``window`` lines from its own on. A surge is a sum of ``threshold`` or more; the range
    goes back over lines of a length over 0 that stand in ``running`` text. A dive is a sum of 0.
    """
    n = len(lengths)
    upto = [0]
    for x in lengths:
        upto.append(upto[-1] + x)
    sums = [upto[min(n, i + window)] - upto[i] for i in range(n)]
    found, i, free = [], 0, 0
    while i < n:
        if sums[i] < max(1, threshold):
            i += 1
            continue
        first = i
        while not lengths[first]:
            first += 1
        while running and first > free and lengths[first - 1] and running[first - 1]:
            first -= 1
        while i < n and sums[i]:
            i += 1
        last = min(i, n - 1)
        while not lengths[last]:
            last -= 1
        found.append((first, last + 1))
        free = last + 1
    return found


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of a page; empty for null, an empty page or one without any. What a browser does not show (scripts, templates, ``noscript``) is no text."""
    if not page:
        return ""
    got = lines(page)
    if any(x.inside and not x.off for x in got):
        got = [x if x.inside else x._replace(length=0, off=True) for x in got]
        keep = spans([x.length for x in got], 1, window)
        keep = [(keep[0][0], keep[-1][1])] if keep else []
    else:
        threshold = min(surge, max((sum(x.length for x in got[i : i + window]) for i in range(len(got))), default=0))
        keep = spans([x.length for x in got], threshold, window, [True] * len(got))
    return "\n".join(got[k].text for a, b in keep for k in range(a, b) if not got[k].off)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text``, ``n_chars``: one row per row of ``df``, repeated rows too; null html counts as empty. Whole pages count; no other column is read or carried."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    out = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
