"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block element's run of text; elements that never hold the
article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of
readers) leave an empty line, or nothing where they stand inside a line. Over the lines' lengths
(text of links counts nothing, so menus are flat), sums of ``width`` lines in a row make a curve. From
the peak of the curve the region reaches back to its surge and on to its dive, the places where the
curve falls to nothing, such as at some unwanted elements in a row.

The peak's article bounds the text: the innermost article or main element, or the outermost one that
is named as content, wherever surge and dive lie in it. On a page without any, the text is what
stands between surge and dive: past a dive it goes on while lines of the element that holds the
region surge again, and at its edges short lines count only if they are headings or stand in the
region's own blocks, not in others (an imprint, a menu without links).

A null, empty or textless page gives an empty text. Rows are judged one by one; other columns are
passed on. All steps take time in proportion to the page, whatever its tags.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

# Element names of the HTML standard by their role here.
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "dialog", "button", "select", "noscript", "template", "iframe", "object", "menu", "svg", "canvas", "audio", "video"}
RAW = {"script", "style", "textarea", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements whose end tag may be left out, so they are not counted as open.
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "optgroup", "colgroup", "rb", "rt", "rp"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of class and id names that mark what is not the article.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar"}

#: Words of class and id names that mark what holds the article.
HOLDS = {"article", "content", "entry", "main", "post", "story"}

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE = re.compile(r"""["'>]""")
OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
WHOLE = {"html", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
IMPRINT = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.IGNORECASE)


@dataclass(frozen=True)
class Curve:
    #: Lines of a window.
    width: int = 3
    #: A surge needs a window of so many characters; less, if no window of the page has them.
    surge: int = 80


def unwanted(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if not attributes or name in WHOLE or name in ("article", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and not MARKS.isdisjoint(WORD.findall(value)):
            return True
    return False


def holds(name: str, attributes: str) -> int:
    """Whether the element holds an article: 3 it is one, 2 main content, 1 named as content, 0 no."""
    found = {"article": 3, "main": 2}.get(name, 0)
    if name in WHOLE or found or not attributes:
        return found
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role":
            found = max(found, {"article": 3, "main": 2}.get(value, 0))
        elif key in ("class", "id") and not HOLDS.isdisjoint(WORD.findall(value)):
            found = max(found, 1)
    return found


@dataclass
class Line:
    text: str
    #: Characters outside links.
    plain: int
    #: The innermost open element, by number; 0: none but html and body.
    element: int
    #: The block it was in: the last tag before it.
    block: str


class Page:
    """The page's lines in order, and its elements: which holds which, and from which line to which."""

    def __init__(self, page: str):
        self.page = page
        self.lines: list[Line] = []
        #: Of each element: the one around it, its first line, the line after its last, and its rank (see holds).
        self.above, self.first, self.past, self.rank = [0], [0], [0], [0]
        self.quotes = True
        self.read()
        self.past[0] = len(self.lines)

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``: past its >, which does not count in quotes; -1: nowhere.

        Once a quote stays open, quotes no longer count on this page: one pass over it is enough.
        """
        begin = at
        while self.quotes and (m := QUOTE.search(self.page, at)):
            if m[0] == ">":
                return m.end()
            at = self.page.find(m[0], m.end()) + 1
            if not at:
                self.quotes = False
        return self.page.find(">", begin) + 1 or -1

    def read(self) -> None:
        page, size, at = self.page, len(self.page), 0
        stack: list[tuple[str, int]] = []  # name and number of open elements; inline ones only inside unwanted parts
        opened: dict[str, int] = {}
        parts: list[str] = []
        plain = linked = 0
        muted, inline = 0, False  # how many elements are open up to the unwanted one, and whether that is inline
        block, more = "", True

        def close_line(mark: bool = False) -> None:
            nonlocal plain
            text = " ".join("".join(parts).split())
            parts.clear()
            if text or mark:
                self.lines.append(Line(text, min(plain, len(text)), stack[-1][1] if stack else 0, block))
            plain = 0

        def push(name: str, rank: int) -> None:
            own = 0
            if name not in WHOLE:
                own = len(self.above)
                self.above.append(stack[-1][1] if stack else 0)
                self.first.append(len(self.lines))
                self.past.append(-1)
                self.rank.append(rank)
            stack.append((name, own))
            opened[name] = opened.get(name, 0) + 1

        def pop() -> None:
            name, own = stack.pop()
            opened[name] -= 1
            if own:
                self.past[own] = len(self.lines)

        def pop_to(depth: int) -> None:
            """Close elements; what stands in an unwanted one leaves an empty line."""
            nonlocal muted, inline
            while len(stack) > depth:
                pop()
            if muted and len(stack) < muted:
                if not inline:
                    close_line(mark=True)
                muted, inline = 0, False

        while at < size:
            found = OPEN.search(page, at) if more else None
            start = found.start() if found else size
            if start > at and not muted:
                text = html.unescape(page[at:start])
                parts.append(text)
                if not linked:
                    plain += len(text)
            if not found:
                break
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            named = NAME.match(page, start)
            end = self.tag_end(named.end()) if named else page.find(">", start) + 1 or -1
            if end < 0:
                if named:  # no tag ends after this, so all else is text
                    at, more = start, False
                    continue
                at = size
                continue
            at = end
            if not named:  # a declaration, or an end tag without a name
                continue
            closing, name, attributes = named[1], named[2].lower(), page[named.end() : end - 1]
            if not closing and name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else size
                if not muted:
                    close_line()
                continue
            if name in INLINE:
                if name == "a" and not muted:
                    linked = 0 if closing else 1
                if closing:
                    if opened.get(name):
                        depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
                        pop_to(depth)
                elif name not in VOID and (muted or unwanted(name, attributes)):
                    push(name, 0)
                    if not muted:
                        muted, inline = len(stack), True
                continue
            linked = 0
            if inline and name in LOOSE and all(k[0] in INLINE for k in stack[muted - 1 :]):
                pop_to(muted - 1)  # a paragraph that ends takes an open inline element with it
            if not muted:
                close_line()
                block = name
            if name in VOID or closing and name in LOOSE:
                continue
            if closing:
                if opened.get(name) and name not in WHOLE:
                    pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
                continue
            if name in LOOSE:
                if not muted and unwanted(name, attributes):  # it ends where the next begins, or with what holds it
                    skip = re.compile(rf"</?{re.escape(name)}(?=[\s/>])|</(?:ul|ol|dl|table|div|section|article|body)(?=[\s/>])", re.IGNORECASE).search(page, at)
                    at = skip.start() if skip else size
                    close_line(mark=True)
                continue
            bad = not muted and unwanted(name, attributes)
            push(name, holds(name, attributes))
            if bad:
                muted = len(stack)
        if not muted:
            close_line()
        while stack:
            pop()

    def container(self, line: int) -> int:
        """The element whose text belongs together around a line; 0: none."""
        best, element = 0, self.lines[line].element
        while element:
            rank = self.rank[element]
            if rank > self.rank[best] or rank == self.rank[best] == 1:
                best = element
            element = self.above[element]
        return best

    def around(self, first: int, last: int) -> int:
        """The innermost element that holds the lines from first to last; 0: none."""
        element = self.lines[first].element
        while element and self.past[element] <= last:
            element = self.above[element]
        return element


def windows(sizes: list[int], curve: Curve) -> list[int]:
    """For each line the characters of the window that begins with it."""
    sums = [0]
    for n in sizes:
        sums.append(sums[-1] + n)
    return [sums[min(len(sizes), k + curve.width)] - sums[k] for k in range(len(sizes))]


def surge(window: list[int], at: int, least: int, curve: Curve) -> int:
    """Where the curve surged, going back from ``at``."""
    while at and window[at - 1] > 0 and max(window[max(0, at - curve.width) : at]) >= least:
        at -= 1
    return at


def past_dives(found: Page, first: int, last: int, least: int, curve: Curve) -> tuple[int, int]:
    """The region with further surges of the element that holds it: the curve of its lines without unwanted parts."""
    lines, element = found.lines, found.around(first, last)
    # Straight below body only lines that stand there too are of the same text.
    inside = range(found.first[element], found.past[element])
    own = [k for k in inside if lines[k].text and (element or not lines[k].element)]
    high = [j for j, x in enumerate(windows([lines[k].plain for k in own], curve)) if x >= least]
    if not high:
        return first, last
    return min(first, own[high[0]]), max(last, own[min(high[-1] + curve.width, len(own)) - 1])


def article(page: str | None, curve: Curve = Curve()) -> str:
    found = Page(page or "")
    lines = found.lines
    if not any(line.text for line in lines):
        return ""
    sizes = [line.plain for line in lines]
    if not any(sizes):
        sizes = [len(line.text) for line in lines]
    window = windows(sizes, curve)
    peak = max(range(len(lines)), key=window.__getitem__)
    least = min(curve.surge, window[peak])
    first = surge(window, peak, least, curve)
    last = peak
    while last + 1 < len(lines) and window[last + 1] > 0:
        last += 1
    bounds = found.container(max(range(peak, min(peak + curve.width, len(lines))), key=sizes.__getitem__))
    if bounds:
        return " ".join(line.text for line in lines[found.first[bounds] : found.past[bounds]] if line.text)
    first, last = past_dives(found, first, last, least, curve)
    heavy = [k for k in range(first, last + 1) if sizes[k] * curve.width >= least]
    blocks = {(lines[k].element, lines[k].block) for k in heavy}

    def edge(k: int) -> bool:
        line = lines[k]
        return bool(sizes[k]) and not IMPRINT.match(line.text) and ((line.element, line.block) in blocks or line.block in HEADINGS and k < heavy[0])

    while first < heavy[0] and not edge(first):
        first += 1
    while last > heavy[-1] and not edge(last):
        last -= 1
    return " ".join(line.text for line in lines[first : last + 1] if line.text)


def extract(pages: DataFrame, curve: Curve = Curve()) -> DataFrame:
    """``pages`` (html and others that are passed on) with text and n_chars in place of html."""
    mine = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]

    def run(batches):
        for batch in batches:
            texts = [article(x.as_py(), curve) for x in batch.column("html")]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in mine), *columns], [*mine, "text", "n_chars"])

    kept = pages.select(*[F.col(f"`{c}`") for c in mine], "html")
    return common.to_python(kept).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "html"), "text string, n_chars long"]))


#: The query's rows in DuckDB, for pages whose article is one element of paragraphs, headings and bold
#: text and whose references are these; the operator itself takes any page.
SQL = r"""
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(
    regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g'),
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text
  FROM pages
)
"""
