"""Markdown notes in plain Python: frontmatter, code, headings, wikilinks and their positions.

CommonMark's block structure: containers (quotes and list items, with lazy lines) and what they hold, read line by
line; headings' texts by its inline rules (see inline.py). Offsets are code points of the whole text. No Spark here, so workers and
tests can use it alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from .inline import AUTOLINK, DEFINITION, TAG, label, plain

#: Characters of the White_Space property.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
FRONTMATTER = re.compile(r"\A---\r*\n(?:.*?\n)??---\r*(?:\n|\Z)", re.DOTALL)
FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
CLOSING = re.compile(r"(`{3,}|~{3,})[ \t]*$")
SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
MARKER = re.compile(r"([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
# Element names of CommonMark that begin a block of HTML, which a blank line ends.
HTML_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
BLANK_LINE = re.compile(r"\A\s*\Z")
#: How blocks of HTML begin and what ends them; the last kind does not interrupt a paragraph.
HTML_BLOCKS = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?=[\s>]|$)", re.IGNORECASE), re.compile("</(?:script|pre|style|textarea)>", re.IGNORECASE)),
    (re.compile(" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(" {0,3}<![A-Za-z]"), re.compile(">")),
    (re.compile(rf" {{0,3}}</?(?:{'|'.join(HTML_NAMES)})(?=\s|/?>|$)", re.IGNORECASE), BLANK_LINE),
    (re.compile(r""" {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"""), BLANK_LINE),
]
TICKS = re.compile("`+")
WIDE = re.compile("[\U00010000-\U0010ffff]")
MARKED = re.compile(rf"\\[\s\S]|`+|{AUTOLINK}|{TAG}")

Range = tuple[int, int]


@dataclass
class Note:
    """What a note holds: headings in order, ranges of code, and its links' texts and ranges."""

    body: int = 0
    headings: list[str] = field(default_factory=list)
    code: list[Range] = field(default_factory=list)
    links: list[tuple[str, int, int]] = field(default_factory=list)
    brackets: list[Range] = field(default_factory=list)


def body_start(text: str) -> int:
    m = FRONTMATTER.match(text)
    return m.end() if m else 0


def code_spans(text: str, start: int, end: int) -> list[Range]:
    """Runs of backticks and their partners of the same length, inside one block; none begins in a tag or address."""
    ticks, opens = [], []
    for m in MARKED.finditer(text, start, end):
        if m[0][0] == "`":
            opens.append((m.start(), m.end()))
        elif m[0] == "\\`":  # escaped: the rest of its run may open
            more = TICKS.match(text, m.end(), end)
            opens += [(m.end(), more.end())] if more else []
    places: dict[int, list[int]] = {}  # of runs, by their length
    for m in TICKS.finditer(text, start, end):
        places.setdefault(m.end() - m.start(), []).append(m.start())
    out, at = [], start
    for a, b in opens:
        if a < at:
            continue
        same = places.get(b - a, [])
        mate = bisect_left(same, b)
        if mate < len(same):
            at = same[mate] + b - a
            out.append((a, at))
    return out


class _Line:
    """A line that is read from the left, in columns: a tab goes on to the next fourth one, and may be used in part."""

    def __init__(self, text: str):
        self.text, self.pos, self.col, self.left = text, 0, 0, 0

    def indent(self) -> tuple[int, int]:
        """Columns of white space from here, and where it ends."""
        n, p, col = self.left, self.pos, self.col + self.left
        while p < len(self.text) and self.text[p] in " \t":
            width = 4 - col % 4 if self.text[p] == "\t" else 1
            n, col, p = n + width, col + width, p + 1
        return n, p

    def skip(self, columns: int) -> None:
        """Over white space of at most so many columns."""
        while columns > 0:
            if self.left:
                used = min(self.left, columns)
                self.left, self.col, columns = self.left - used, self.col + used, columns - used
            elif self.text[self.pos : self.pos + 1] == "\t":
                self.left = 4 - self.col % 4
                self.pos += 1
            elif self.text[self.pos : self.pos + 1] == " ":
                self.pos, self.col, columns = self.pos + 1, self.col + 1, columns - 1
            else:
                return

    def to(self, p: int) -> None:
        n, end = self.indent()
        self.col, self.left = self.col + n + p - end, 0
        self.pos = p


class _Blocks:
    """Reads lines one after another: ``containers`` are open quotes (0) and items (their width), ``leaf`` what they hold."""

    def __init__(self, text: str, start: int):
        self.text = text
        self.code: list[Range] = []
        self.heads: list[list[Range]] = []  # a range for each line of a heading
        self.paragraphs: list[Range] = []
        self.defined: set[str] = set()
        self.containers: list[list] = []  # width (0 is a quote), whether it is still empty
        self.leaf: str | None = None
        self.lines: list[Range] = []  # of the paragraph that is open
        self.fence = ("", 0)
        self.begun = self.last = start  # of the code that is open, and the end of what was read
        self.ends: re.Pattern | None = None
        at = start
        while at < len(text):
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            end = stop - (stop > at and text[stop - 1] == "\r")
            self.line(at, _Line(text[at:end]))
            self.last, at = end, stop + 1
        self.close(0)

    def finish(self) -> None:
        """The leaf ends before this line."""
        if self.leaf in ("fence", "indented"):
            self.code.append((self.begun, self.last))
        elif self.leaf == "paragraph":
            self.paragraph()
        self.leaf = None

    def close(self, matched: int) -> None:
        self.finish()
        del self.containers[matched:]

    def paragraph(self) -> list[Range]:
        """The lines of a paragraph that are left once definitions at its start are taken."""
        own, self.lines = self.lines, []
        while own and self.text[own[0][0]] == "[":
            said = "\n".join(self.text[a:b] for a, b in own)
            m = DEFINITION.match(said)
            if m is None or not m[1].strip():
                break
            self.defined.add(label(m[1]))
            taken = said.count("\n", 0, m.end()) + (m.end() == len(said) and not said.endswith("\n", 0, m.end()))
            own = own[taken:]
        if own:
            self.paragraphs.append((own[0][0], own[-1][1]))
        return own

    def matches(self, line: _Line) -> int:
        """How many of the open containers the line goes on in."""
        for k, (width, is_empty) in enumerate(self.containers):
            n, p = line.indent()
            blank = p >= len(line.text)
            if not width:
                if n > 3 or blank or line.text[p] != ">":
                    return k
                line.to(p + 1)
                line.skip(1)
            elif blank:
                if is_empty:
                    return k
            elif n >= width:
                line.skip(width)
            else:
                return k
        return len(self.containers)

    def line(self, begin: int, line: _Line) -> None:
        matched = self.matches(line)
        whole = matched == len(self.containers)
        if self.leaf in ("fence", "html"):
            if not whole:
                self.close(matched)
                whole = True
            elif self.goes_on(begin, line):
                return
        opened = False
        while True:
            n, p = line.indent()
            rest = line.text[p:]
            if not rest:
                self.blank(matched, opened)
                return
            if n >= 4:
                if self.leaf == "paragraph" and not opened:
                    break
                if not (self.leaf == "indented" and whole and not opened):
                    self.close(matched)
                    line.skip(4)
                    self.leaf, self.begun = "indented", begin + line.pos
                self.filled()
                return
            step = self.container(n, p, rest, line, matched, whole and not opened)
            if step is None:
                break
            matched, opened = step, True
        if n >= 4:
            pass  # a paragraph goes on
        elif self.leaf == "paragraph" and whole and not opened and SETEXT.match(rest):
            lines = self.paragraph()
            self.leaf = None
            if lines:
                self.heads.append(lines)
                return
        elif self.block(begin + p, rest, line, matched, opened):
            self.filled()
            return
        if self.leaf == "paragraph" and not opened:  # as it goes on, or as a lazy line
            self.lines.append((begin + p, begin + len(line.text)))
            return
        self.close(matched)
        self.leaf = "paragraph"
        self.lines = [(begin + p, begin + len(line.text))]
        self.filled()

    def filled(self) -> None:
        for c in self.containers:
            c[1] = False

    def blank(self, matched: int, opened: bool) -> None:
        if self.leaf == "indented" and matched == len(self.containers) and not opened:
            return  # it may go on after blank lines
        self.close(matched)

    def goes_on(self, begin: int, line: _Line) -> bool:
        """Whether fenced code or HTML takes the line."""
        n, p = line.indent()
        rest = line.text[p:]
        if self.leaf == "fence":
            m = CLOSING.match(rest) if n <= 3 else None
            if m and m[1][0] == self.fence[0] and len(m[1]) >= self.fence[1]:
                self.code.append((self.begun, begin + len(line.text)))
                self.leaf = None
            return True
        if self.ends is BLANK_LINE and not rest:
            self.leaf = None
            return False
        if self.ends is not BLANK_LINE and self.ends.search(rest):
            self.leaf = None
        return True

    def container(self, n: int, p: int, rest: str, line: _Line, matched: int, within: bool) -> int | None:
        """Opens a quote or a list item here: how many containers are open then; None if there is none."""
        if rest[0] == ">":
            self.close(matched)
            self.containers.append([0, False])
            line.to(p + 1)
            line.skip(1)
            return len(self.containers)
        m = MARKER.match(rest)
        if m is None or RULE.match(rest):
            return None
        empty = not rest[m.end() :].strip(" \t")
        if self.leaf == "paragraph" and within and (empty or m[2] not in (None, "1") and int(m[2]) != 1):
            return None
        self.close(matched)
        line.to(p + m.end())
        spaces, _ = line.indent()
        width = n + m.end() + (1 if empty or spaces > 4 else spaces)
        line.skip(1 if empty or spaces > 4 else spaces)
        self.containers.append([width, empty])
        return len(self.containers)

    def block(self, where: int, rest: str, line: _Line, matched: int, opened: bool) -> bool:
        """A heading, a fence, HTML or a rule on one line."""
        if m := ATX.match(rest):
            self.close(matched)
            if m[2] is not None:
                span = (where + m.start(2), where + m.end(2))
                self.heads.append([span])
                self.paragraphs.append(span)
            return True
        if m := FENCE.match(rest):
            self.close(matched)
            self.leaf, self.fence, self.begun = "fence", (m[1][0], len(m[1])), where
            return True
        if rest[0] == "<":
            kind = next((k for k, (begins, _) in enumerate(HTML_BLOCKS) if begins.match(rest)), None)
            if kind is not None and not (kind == len(HTML_BLOCKS) - 1 and self.leaf == "paragraph" and not opened):
                self.close(matched)
                self.ends = HTML_BLOCKS[kind][1]
                self.leaf = None if self.ends is not BLANK_LINE and self.ends.search(rest, 2) else "html"
                return True
        if RULE.match(rest):
            self.close(matched)
            return True
        return False


def inside(place: int, ranges: list[Range], starts: list[int]) -> bool:
    k = bisect_right(starts, place) - 1
    return k >= 0 and place < ranges[k][1]


def read(text: str) -> Note:
    """Links keep the text between their brackets; a bracket pair is used up even where it is no link."""
    note = Note(body=body_start(text))
    made = _Blocks(text, note.body)
    note.code = sorted([*made.code, *(c for span in made.paragraphs for c in code_spans(text, *span))])
    said = (plain("\n".join(text[a:b] for a, b in lines), made.defined).strip(BLANK) for lines in made.heads)
    note.headings = [h for h in said if h]
    starts = [a for a, _ in note.code]
    at = text.find("[[", note.body)
    while at >= 0:
        end = text.find("]]", at + 2)
        if end < 0:
            break
        note.brackets.append((at, end + 2))
        inner = text[at + 2 : end].strip(BLANK)
        if inner and "\n" not in inner and not inside(at, note.code, starts):
            note.links.append((text[at + 2 : end], at, end + 2))
        at = text.find("[[", end + 2)
    return note


class Lines:
    """Offsets as (line, character), both from 0."""

    def __init__(self, text: str):
        self.text = text
        self.wide: list[int] | None = None
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def place(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset) - 1
        return line, offset - self.starts[line]

    def utf16(self, offset: int) -> int:
        """UTF-16 units between the line's start and the offset: wide characters before it count twice."""
        start = self.starts[bisect_right(self.starts, offset) - 1]
        if self.wide is None:
            self.wide = [] if self.text.isascii() else [m.start() for m in WIDE.finditer(self.text)]
        return offset - start + bisect_left(self.wide, offset) - bisect_left(self.wide, start)
